"""Fill in the middle: cut each text at two unit ends and reorder prefix, suffix and middle behind sentinels.

Every code point gets the class of itself and of the next one. A wavelet matrix over these classes answers how often a class pair occurs
before a place. The ranks of all pairs that end a unit, added up, count unit ends before a place, and bisection on that count finds both
cuts. One matrix serves a portion of many texts, and its queries are answered for all of them at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import ROW, packed, quoted, unpacked
from candela.llm.hashing import portions
from candela.llm.registry import query, table

WHITE, LINE, LETTER, MARK = range(4)  # white space, line feed, letters, digits and all beyond ASCII, other characters
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Class pairs (a character's, the next one's) that end a unit; a text is followed by a line feed.
UNITS = {
    "word": [(a, b) for a in (LETTER, MARK) for b in (WHITE, LINE)],
    "line": [(LINE, b) for b in range(4)],
}
SCHEMA = "n long, form string, output string, prefix_chars long, middle_chars long"
RESULTS = ["n", "form", "output", "prefix_chars", "middle_chars"]

_ASCII = np.full(128, MARK, dtype=np.uint8)
_ASCII[[c for c in range(128) if chr(c).isalnum()]] = LETTER
_ASCII[[0x20, *range(0x09, 0x0E)]] = WHITE
_ASCII[0x0A] = LINE


class WaveletMatrix:
    """Rank queries over an array of small numbers: one bit vector a level, packed, with the ones before each 64-bit word."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            words = np.zeros(len(symbols) // 64 + 1, dtype="<u8")
            filled = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(filled)] = filled
            before = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, int(len(bit) - np.count_nonzero(bit))))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & low)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each place."""
        first, at = np.zeros(1, dtype=np.int64), at.astype(np.int64)
        for k, (words, before, zeros) in enumerate(self.levels):
            a, b = self._ones(words, before, first), self._ones(words, before, at)
            first, at = (zeros + a, zeros + b) if symbol >> (self.bits - 1 - k) & 1 else (first - a, at - b)
        return at - first


class Boundaries:
    """Unit ends of many texts joined by line feeds."""

    def __init__(self, texts: list[str], unit: str = "word"):
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        classes = np.where(codes < 128, _ASCII[codes & 127], LETTER).astype(np.uint8)
        del codes
        after = np.append(classes[1:], np.uint8(LINE))
        self.matrix = WaveletMatrix(classes * np.uint8(4) + after, 4)
        self.symbols = [4 * a + b for a, b in UNITS[unit]]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.base = self.before(self.start)
        found = self.before(self.end)
        # What follows the last end is one more unit.
        open_end = (sizes > 0) & (found == self.before(np.maximum(self.end - 1, self.start)))
        self.n = found - self.base + open_end

    def before(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(s, at) for s in self.symbols)

    def places(self, which: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Code points of text ``which[k]`` in its first ``units[k]`` units: bisection on the count of unit ends."""
        start = self.start[which]
        low, high, wanted = start, self.end[which], self.base[which] + units
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.before(middle) >= wanted
            high, low = np.where(enough, middle, high), np.where(enough, low, np.minimum(middle + 1, high))
        return high - start


def draws(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits drawn for a key."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def arranged(texts: list[str], keys: list[str], seed: int, percent: int, spm_percent: int, unit: str) -> list[tuple]:
    """The results of each text, in the order of ``RESULTS``."""
    ends = Boundaries(texts, unit)
    drawn = [draws(seed, k) for k in keys]
    cut = [
        k for k, (t, h) in enumerate(zip(texts, drawn, strict=True))
        if t and h[2] % 100 < percent and not any(s in t for s in (PREFIX, SUFFIX, MIDDLE))
    ]
    which = np.array(cut, dtype=np.int64)
    units = np.sort(np.array([[drawn[k][0], drawn[k][1]] for k in cut], dtype=np.int64).reshape(-1, 2) % (ends.n[which, None] + 1), axis=1)
    first, second = ends.places(which, units[:, 0]).tolist(), ends.places(which, units[:, 1]).tolist()
    out = [(n, "plain", t, None, None) for n, t in zip(ends.n.tolist(), texts, strict=True)]
    for k, a, b in zip(cut, first, second, strict=True):
        t = texts[k]
        spm = drawn[k][3] % 100 < spm_percent
        p, s = f"{PREFIX}{t[:a]}", f"{SUFFIX}{t[b:]}"
        out[k] = (out[k][0], "spm" if spm else "psm", f"{s}{p}{MIDDLE}{t[a:b]}" if spm else f"{p}{s}{MIDDLE}{t[a:b]}", a, b - a)
    return out


def transform(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 42, percent: int = 50, spm_percent: int = 80, unit: str = "word",
    results: list[str] = RESULTS,
) -> DataFrame:
    """Every row with ``n`` (its units), ``form`` (plain, psm or spm), ``output`` (the new text), ``prefix_chars`` and ``middle_chars``.

    ``percent`` of the keys are cut, ``spm_percent`` of these suffix first; where, is drawn from the seed and the key. A unit is a word
    with the white space before it, or a line. Null and empty texts, and texts that hold a sentinel, stay plain; the two lengths are
    then null. A null key draws like an empty one; repeated rows give the same result each; an empty table gives an empty result. Texts
    are worked on in portions of about a million characters, a longer text alone, with some 20 bytes a character. ``results`` renames
    the five; input columns named like a result are replaced by it, all others are kept.
    """

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for bodies, keys in batches:
            texts, names, rows = bodies.to_pylist(), keys.to_pylist(), []
            for part in portions(texts):
                rows += arranged(texts[part], names[part], seed, percent, spm_percent, unit)
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=RESULTS)

    body, name = F.coalesce(F.col(quoted(text)), F.lit("")), F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))
    rows = packed(docs, run(body, name).alias("found"))
    return unpacked(rows.select(ROW, *[F.col(f"found.{c}").alias(n) for c, n in zip(RESULTS, results, strict=True)]), docs.columns, results)


def restored(output: Column, form: Column) -> Column:
    """The exact text again. A sentinel can't arise where parts meet, as no sentinel holds another's mark inside."""

    def between(opening: str, closing: str) -> Column:
        return F.substring_index(F.substring_index(output, opening, -1), closing, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@query(
    "op11_fill_in_middle",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
  CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
  greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b, u, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>')
  OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
  array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = transform(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
