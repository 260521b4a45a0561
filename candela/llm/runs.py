"""Periodic runs of words: stretches that repeat a phrase four times or more, found by uniting suffix classes.

Suffixes that share their first words form a class, an ordered set of positions. Classes are united by decreasing length of the common
prefix (LCP), the smaller into the larger with union-find. Two positions of the two classes that become neighbours share exactly LCP
words. If their distance is within a third of that, they start or continue a run with this distance as period; the pair whose words
before it differ is the run's start. So every run is found once, with its whole length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import ROW, let, packed, quoted, unpacked
from candela.llm.hashing import BASE, mixed
from candela.llm.registry import query, table

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
SEED = 5  # words that a run's first position and the one a period later share at least
SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RESULTS = ["n_words", "runs", "collapsed"]


def repeated(ids: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of ``SEED`` words whose hash occurs twice; all words of runs do."""
    n = len(ids) - SEED + 1
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        sums = mixed(sums * BASE + ids[k : k + n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    covered[twice] += 1
    np.subtract.at(covered, twice + SEED, 1)
    return np.cumsum(covered)[:-1] > 0


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions sorted by their suffixes, and the LCP of each with its successor: by ranks of 1, 2, 4, ... words."""
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    while levels[-1].max() + 1 < n:
        rank, step = levels[-1], 1 << (len(levels) - 1)
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[k], -1)
        equal = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (np.maximum(a, b) < n)
        step = equal.astype(np.int64) << k
        a, b, shared = a + step, b + step, shared + step
    return order, shared


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's word numbers, sorted by start, then period."""
    if len(ids) < LEAST:
        return []
    place = np.flatnonzero(repeated(ids))
    if not len(place):
        return []
    # Words outside of repeated windows can't be in a run: one word that occurs nowhere else stands for each such stretch.
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    words = np.insert(ids[place], gap, int(ids.max()) + 1 + np.arange(len(gap)))
    place = np.insert(place, gap, -1).tolist()
    order, shared = suffixes(words)
    edges = np.flatnonzero(shared >= SEED)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    left, right, lcps = order[edges].tolist(), order[edges + 1].tolist(), shared[edges].tolist()
    words = words.tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while x != top:
            parent[x], x = top, parent.get(x, top)
        return top

    found = []
    for a, b, lcp in zip(left, right, lcps, strict=True):
        a, b = root(a), root(b)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b] = a
        new = set(small)
        if 8 * len(small) > len(large):
            large = sorted(large + small)
        else:
            for p in small:
                insort(large, p)
        members[a] = large
        for p in small:
            k = bisect_left(large, p)
            for q in (*large[max(k - 1, 0) : k], *large[k + 1 : k + 2]):
                start, period = min(p, q), abs(p - q)
                if (TIMES - 1) * period <= lcp and period + lcp >= LEAST and q not in new:
                    if not start or words[start - 1] != words[start - 1 + period]:
                        found.append((place[start], period + lcp, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those in a run after its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0)])


def examined(text: str) -> tuple[int, list[tuple[int, int, int]], bytes]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes part at 0x20 and 0x09 to 0x0D only
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    runs = runs_of(ids)
    return len(words), runs, collapsed(words, runs)


def with_runs(docs: DataFrame, text: str = "text", results: list[str] = RESULTS) -> DataFrame:
    """Every row with ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``: its words,
    joined by a space, without what runs repeat.

    Words lie between ASCII white space. Null, empty and blank texts have no words, no runs and an empty ``collapsed``; repeated rows
    give the same each; an empty table gives an empty result. A text is worked on alone: n log n for its repeated words, with some
    hundred bytes a word. ``results`` renames the three; input columns named like a result are replaced by it, all others are kept.
    """

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for bodies in batches:
            counts, ends, flat, texts = [], [0], [], []
            for body in bodies:
                n, runs, kept = examined(body.as_py())
                counts.append(n)
                flat += runs
                ends.append(len(flat))
                texts.append(kept)
            rows = np.array(flat, dtype=np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=RESULTS)

    rows = packed(docs, run(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("found"))
    return unpacked(rows.select(ROW, *[F.col(f"found.{c}").alias(n) for c, n in zip(RESULTS, results, strict=True)]), docs.columns, results)


def longest(runs: Column) -> Column:
    """The run with the greatest length, of equal ones the first, then the one with the least period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))


def planted(doc_id: Column, text: Column) -> Column:
    """The text of one id in ten with its tail replaced by repetitions of a stretch; where and how long, the id's checksum says."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        order = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        changed = let(order, lambda at: F.array_join(F.transform(at, lambda k: F.get(words, k.cast("int"))), " "))
        return F.when(n > 0, changed).otherwise(F.lit(""))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeat)).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    made = with_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    return made.select("*", longest(F.col("runs")).alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
