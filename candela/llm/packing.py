"""Pack documents into training sequences by bounded-space online best fit.

Documents become token ids and are cut only where they are longer than a sequence. Pieces are dealt to groups of bounded size; in a
group, each piece goes to the open sequence with the least room that still fits it. Open sequences are kept in lists by free space, and
a bitset of the free spaces in use finds the list. Only a fixed number stay open; the fullest closes first.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from candela.llm.columns import quoted
from candela.llm.language import small_batches
from candela.llm.registry import query, table
from candela.session import checkpointed

LENGTH = 4096
OPEN = 4096  # sequences that may be open at a time
GROUP = 16_384  # pieces a task packs together, about
END = 1  # id that closes each document
KNOWN_WORDS = 700_000
PIECE = ["piece", "start", "length", "ids_crc32"]
# Separators that Python's split() knows but a tokenizer may treat as text.
RARE_SPACE = re.compile("[\x1c-\x1f\x85]")
MARKS = ".,;:!?#*$%&|"  # marks that may follow a plain word


def latin(text: str) -> bool:
    """Whether a text has no character beyond Latin-1; lower-casing such a text is the same letter by letter."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """Token ids of texts under a tokenizer file whose pre-tokenizer never joins text across white space, and parts letters from marks.

    Ids of each white-space-delimited word are remembered, so a text costs one lookup a word. New plain words (Latin letters, then
    perhaps marks) are split into letters and marks, whose ids are found apart. Memory is bounded: once ``KNOWN_WORDS`` are
    remembered, further words are kept for their batch only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The pre-tokenizer's own form of each letter beyond ASCII.
        parted = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): parted(c)[0][0] for c in map(chr, range(0x80, 0x100)) if c.isalpha()}
        self.words: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain_word(self, word: str) -> bytes:
        """Ids of one word of lower-case Latin letters: it needs no normalisation and is one pre-token, so the merges suffice."""
        found = self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.letters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _learn(self, new: set[str]) -> list[str]:
        """Remember the words; returns the plain words among them that were new too."""
        words, plain, marks, added = self.words, self.plain, self.marks, []
        for word in new:
            core = word.rstrip(MARKS)
            low = core.lower()
            ids = plain.get(low)
            if ids is None:
                if not core.isalpha() or not latin(core):
                    words[word] = self._whole(word)
                    continue
                ids = plain[low] = self._plain_word(low)
                added.append(low)
            if len(core) == len(word):
                words[word] = ids
                continue
            tail = word[len(core) :]
            if tail not in marks:
                if len(marks) > 10_000:
                    marks.clear()
                marks[tail] = self._whole(tail)
            words[word] = ids + marks[tail]
        return added

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [None if RARE_SPACE.search(t) else (t.lower() if "<|" not in t and latin(t) else t).split() for t in texts]
        new = set().union(*(p for p in split if p is not None)) - self.words.keys()
        plain = self._learn(new)
        get = self.words.__getitem__
        out = [self._whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, split, strict=True)]
        for known, added in ((self.words, new), (self.plain, plain)):
            if len(known) > KNOWN_WORDS:
                for word in added:
                    del known[word]
        return out


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder a Python worker, kept between its tasks."""
    if path not in _WORD_IDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def cut(ids: bytes, end: int = END, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a document's ids and its closing id."""
    body = ids + np.array([end], dtype="<u4").tobytes()
    return [
        (k, at // 4, len(part) // 4, zlib.crc32(part))
        for k, at in enumerate(range(0, len(body), 4 * length))
        for part in (body[at : at + 4 * length],)
    ]


def pieces_of(docs: DataFrame, tokenizer: str, keys: list[str], text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Each document's pieces: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and the ``keys`` columns as they are.

    ``docs`` needs doc_id, ``text`` and ``keys``. Null texts count as empty: one piece that holds only the closing id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            found = [cut(ids, end, length) for ids in coder.encode(["" if t is None else t for t in texts])]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            rows = batch.drop_columns(["_text"]).take(pa.array(at))
            flat = np.array([p for f in found for p in f], dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *[pa.array(flat[:, k]) for k in range(4)]], names=[*rows.schema.names, *PIECE]
            )

    rows = docs.select("doc_id", *keys, F.col(quoted(text)).alias("_text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema] + [f"{c} long" for c in PIECE]
    return rows.mapInArrow(run, ", ".join(schema))


def best_fit(lengths: list[int], size: int = LENGTH, most_open: int = OPEN) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece in turn; sequences are numbered as they open.

    ``room[f]`` lists the open sequences with f free places, and bit f of ``used`` says that the list is not empty. The lowest set bit
    at or above a piece's length is the best fit. Beyond ``most_open`` the fullest sequence, at the lowest set bit, closes.
    """
    room: list[list[int]] = [[] for _ in range(size + 1)]
    used = n_open = sequences = 0
    out = []
    for need in lengths:
        fits = used >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                used &= ~(1 << free)
            n_open -= 1
        else:
            free, at = size, sequences
            sequences += 1
        out.append((at, size - free))
        left = free - need
        if left:
            room[left].append(at)
            used |= 1 << left
            n_open += 1
            if n_open > most_open:
                fullest = (used & -used).bit_length() - 1
                room[fullest].pop()
                if not room[fullest]:
                    used &= ~(1 << fullest)
                n_open -= 1
    return out


def pack(pieces: DataFrame, group: Column, order: list[str], size: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``group`` (a whole number, 0 or more) says which pieces are packed together, each
    group in one task; ``order`` are the columns that order a group's pieces. Groups must be bounded by their maker."""
    columns = pieces.columns

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([(f"_o{k}", "ascending") for k in range(len(order))])
        placed = np.array(best_fit(batch.column("length").to_pylist(), size, most_open), dtype=np.int64).reshape(-1, 2)
        base = batch.column("_group")[0].as_py() << 32
        out = batch.select(columns)
        return out.append_column("sequence_id", pa.array(base + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))

    keyed = pieces.select("*", group.alias("_group"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return keyed.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, text: str = "text", size: int = LENGTH, most_open: int = OPEN, per_group: int = GROUP
) -> DataFrame:
    """Pack all documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, a row a piece.

    Long pieces are packed first, which needs the fewest sequences. Pieces go to groups by their hash, about ``per_group`` in each, and
    a group loses less than a sequence. Null texts count as empty; a null doc_id is packed like any other; repeated rows are packed
    each; an empty table gives an empty result. Other columns are not used.
    """
    small_batches(docs.sparkSession)
    pieces = checkpointed(pieces_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer, [], text, size))
    groups = max(1, ceil(pieces.count() / per_group))
    turn = pieces.select("*", (-F.col("length")).alias("_turn"))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    return pack(turn, dealt, ["_turn", "doc_id", "piece"], size, most_open).drop("_turn").withColumn("piece", F.col("piece").cast("int"))


def stored_place(docs: DataFrame) -> DataFrame:
    """Rows with ``_file`` and ``_row``: the file and the row in it that a table read from files holds them at. A table that isn't read
    from files has one file and no order of its own; its rows are then ordered by doc_id."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.select("*", F.lit("").alias("_file"), F.col("doc_id").cast("long").alias("_row"))


def pack_in_order(
    docs: DataFrame, tokenizer: str, text: str = "text", size: int = LENGTH, most_open: int = 64, per_group: int = 4096
) -> DataFrame:
    """Pack all documents in the order they are stored in, so that a mixed table stays mixed: sequence numbers rise with the place.

    As ``pack_documents``, but pieces come in their stored order, ``per_group`` rows of a file at a time, and at most ``most_open``
    sequences wait for a fitting piece.
    """
    small_batches(docs.sparkSession)
    placed = stored_place(docs.withColumn("doc_id", F.col("doc_id").cast("long")) if docs.schema["doc_id"].dataType != LongType() else docs)
    pieces = checkpointed(pieces_of(placed, tokenizer, ["_file", "_row"], text, size))
    stretch = F.coalesce(F.floor(F.col("_row") / per_group), F.lit(-1)).cast("long")
    pieces = pieces.withColumn("_stretch", stretch)
    # One row for each stretch of rows in a file.
    groups = pieces.select("_file", "_stretch").distinct()
    groups = groups.select("*", (F.row_number().over(Window.orderBy("_file", "_stretch")) - 1).cast("long").alias("_number"))
    rows = pieces.join(groups, ["_file", "_stretch"])
    packed = pack(rows, F.col("_number"), ["_row", "doc_id", "piece"], size, most_open)
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def public_tokenizer(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizer("word_bpe_49k.json"))
