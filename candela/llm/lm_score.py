"""Language-model scores by cross-entropy difference: how much better a target model predicts a text than a background model.

Both are bigram models with the same vocabulary, the same bigrams and the same smoothing; only the counts differ. Counts come from all
rows by distributed sums. ``score_against`` uses all words and bigrams: blocks of texts send theirs out once and get the counts back.
``fit`` makes a small model to keep: its vocabulary holds words whose share of all tokens is at least a threshold, and likewise bigrams,
so neither can hold more than one over the threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import ROW, packed, quoted, unpacked
from candela.llm.hashing import portions, word_hashes
from candela.llm.language import small_batches
from candela.llm.registry import query, table

WORD_SHARE, PAIR_SHARE = 2e-5, 1e-5  # at most 50 000 words and 100 000 bigrams
COUNTED_AT_ONCE = 2_000_000  # tokens whose bigrams a task sums before it hands them on
SIDES = ["t", "b", "o"]  # target, background, and only asked for
BODIES = "bigrams binary, words binary, ids binary, times binary, texts binary"
_BODIES = [(c.split()[0], pa.binary()) for c in BODIES.split(", ")]
DEALT = pa.schema([("dealt", pa.int64()), ("block", pa.int64()), ("asked", pa.bool_()), *_BODIES])
COUNTED = pa.schema([("block", pa.int64()), ("part", pa.int64()), *_BODIES])
PRIOR = 5.0  # weight of the unigram model in each bigram's distribution
RESULTS = ["n_tokens", "target_loss", "background_loss", "score"]
SCHEMA = "n_tokens long, target_loss double, background_loss double, score double"


def tokens(text: str | None) -> list[str]:
    """Words between white space, lower-cased."""
    return (text or "").lower().split()


@dataclass
class MatchedModels:
    """Words with their numbers from 1 (0: every other word and the start), and counts in target and background side by side."""

    words: list[str]
    unigrams: np.ndarray  # (words + 1, 2)
    pairs: np.ndarray  # bigram codes, sorted
    pair_counts: np.ndarray  # (pairs, 2)
    prior: float = PRIOR
    _number: dict | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_number": None}

    def numbers(self, words: list[str]) -> np.ndarray:
        if self._number is None:
            self._number = {w: k + 1 for k, w in enumerate(self.words)}
        get = self._number.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """A code for each word with the one before it; before the first stands 0."""
        return np.concatenate([[0], numbers[:-1]]) * (len(self.words) + 1) + numbers

    def losses(self, text: str | None) -> tuple[int, float, float]:
        """Tokens, and the mean loss (natural logarithm) a token under the target and the background model; 0 without tokens."""
        now = self.numbers(tokens(text))
        if not len(now):
            return 0, 0.0, 0.0
        before = np.concatenate([[0], now[:-1]])
        seen = np.zeros((len(now), 2))
        if len(self.pairs):
            code = self.codes(now)
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[at] == code
            seen[hit] = self.pair_counts[at[hit]]
        size = self.unigrams.shape[0]
        alone = (self.unigrams[now] + 1) / (self.unigrams.sum(axis=0) + size)
        given = (seen + self.prior * alone) / (self._followed[before] + self.prior)
        target, background = -np.log(given).mean(axis=0)
        return len(now), float(target), float(background)

    @property
    def _followed(self) -> np.ndarray:
        """How often each word stands first in a kept bigram."""
        if "_first" not in self.__dict__:
            first = np.zeros(self.unigrams.shape)
            np.add.at(first, self.pairs // self.unigrams.shape[0], self.pair_counts)
            self.__dict__["_first"] = first
        return self.__dict__["_first"]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums: dict[bool, Counter] = {False: Counter(), True: Counter()}
        for text, target in zip(batch["text"], batch["target"], strict=True):
            sums[bool(target)].update(tokens(text))
        yield pd.concat(
            [
                pd.DataFrame({"word": list(c), "target": t, "n": np.fromiter(c.values(), np.int64, len(c))})
                for t, c in sums.items()
                if c
            ]
            or [pd.DataFrame({"word": [], "target": [], "n": []})]
        )


def _count_pairs(model: MatchedModels):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target in (False, True):
                texts = batch["text"][batch["target"] == target]
                found = [model.codes(model.numbers(t)) for t in map(tokens, texts) if t]
                if found:
                    code, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"code": code, "target": target, "n": n})

    return run


def fit(
    target: DataFrame, background: DataFrame, text: str = "text", word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE,
    prior: float = PRIOR,
) -> MatchedModels:
    """Matched models from the texts of two tables. Null texts count as empty; an empty side leaves all its counts 0.

    A word or bigram is kept if its share in either side's tokens is at least the threshold, so the smaller side has its say.
    """
    body = F.col(quoted(text)).alias("text")
    both = background.select(body, F.lit(False).alias("target")).unionByName(target.select(body, F.lit(True).alias("target")))

    def summed(counts: DataFrame, key: str) -> DataFrame:
        side = [F.sum(F.when(F.col("target") == t, F.col("n")).otherwise(0)).alias(c) for c, t in (("b", False), ("t", True))]
        return counts.groupBy(key).agg(*side)

    words = summed(both.mapInPandas(_count_words, "word string, target boolean, n long"), "word").persist()
    total = words.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()

    def frequent(counts: DataFrame, share: float) -> DataFrame:
        return counts.filter((F.col("t") >= max(2, share * total[0])) | (F.col("b") >= max(2, share * total[1])))

    kept = sorted(frequent(words, word_share).collect(), key=lambda r: r.word)
    words.unpersist()
    named = np.array([(r.t, r.b) for r in kept], dtype=float).reshape(-1, 2)
    rest = np.array([total], dtype=float) - named.sum(axis=0)
    model = MatchedModels([r.word for r in kept], np.vstack([rest, named]), np.zeros(0, np.int64), np.zeros((0, 2)), prior)
    pairs = summed(both.mapInPandas(_count_pairs(model), "code long, target boolean, n long"), "code")
    found = sorted((r.code, r.t, r.b) for r in frequent(pairs, pair_share).collect())
    model.pairs = np.array([c for c, _, _ in found], dtype=np.int64)
    model.pair_counts = np.array([(t, b) for _, t, b in found], dtype=float).reshape(-1, 2)
    return model


def scored(model: MatchedModels, text: Column) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [model.losses(t) for t in texts]
            yield pd.DataFrame([(n, t, b, t - b) for n, t, b in rows], columns=RESULTS)

    return run(text)


def score(docs: DataFrame, model: MatchedModels, text: str = "text") -> DataFrame:
    """Every document with ``n_tokens``, ``target_loss`` and ``background_loss`` a token, and ``score``, their difference: the lower,
    the more the text is like the target.

    Null and empty texts have no tokens, and 0 in all results. Repeated rows stay, each scored alike; an empty table gives an empty
    result. Input columns named like a result are replaced by it, all others are kept.
    """
    rows = packed(docs, scored(model, F.col(quoted(text))).alias("found"))
    return unpacked(rows.select("*", "found.*"), docs.columns, RESULTS)


@dataclass
class Block:
    """Some texts in turn, with the hashes of all their words."""

    words: np.ndarray
    n: np.ndarray  # words of each text
    keys: np.ndarray
    asked: np.ndarray
    sides: np.ndarray  # (3, texts): 1 for target, background, or neither

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words, sorted, with 0 for the start; and of all words in turn the places there of the word before and of itself."""
        words, place = np.unique(np.concatenate([np.zeros(1, np.uint64), self.words]), return_inverse=True)
        return words, *followed(place[1:], self.n)


def followed(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before each word stands the one at its left, and the start, 0, before the first of a text."""
    before = np.concatenate([[0], place])[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    return before, place


def codes(words: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return words[before] ^ (words << np.uint64(1) | words >> np.uint64(63))[now]


def blocks(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[Block]:
    """The texts of a task in blocks of about ``at_once`` words; no text is split."""

    def made() -> Block:
        words, n, keys, asked, sides = zip(*found, strict=True)
        return Block(*map(np.concatenate, (words, n, keys, asked)), np.concatenate(sides, axis=1))

    found, size = [], 0
    for batch in batches:
        texts = batch.column("text").to_pylist()
        facts = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "asked", *SIDES)]
        for part in portions(texts):
            words, at = word_hashes([" ".join(tokens(t)) for t in texts[part]], lower=False)
            key, asked, *sides = (f[part] for f in facts)
            found.append((words, np.diff(at), key, asked, np.array(sides)))
            size += len(words) + len(key)
            if size >= at_once:
                yield made()
                found, size = [], 0
    if found:
        yield made()


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length as compressed bytes, equal places of the bytes side by side."""
    rows = np.ascontiguousarray(np.array(columns).astype(np.int64).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1))
    return rows.size.to_bytes(8, "little") + pa.compress(pa.py_buffer(rows), "zstd", asbytes=True)


def opened(data: bytes, columns: int) -> np.ndarray:
    rows = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(rows.reshape(columns, 8, -1).transpose(0, 2, 1)).view(np.int64)[:, :, 0]


def steps(values: np.ndarray) -> np.ndarray:
    """Sorted hashes by what each is over the one before, which is shorter; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=np.uint64(0)).view(np.int64)


def sums(places: np.ndarray, weights: np.ndarray, size: int) -> list[np.ndarray]:
    return [np.bincount(places, weights=w, minlength=size).astype(np.int64) for w in weights]


def _word_counts(at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, at_once):
            words, place = np.unique(block.words, return_inverse=True)
            counts = sums(place, np.repeat(block.sides, block.n, axis=1), len(words))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words.view(np.int64), *counts)], names=["word", *SIDES])

    return run


def _dealt(parts: int, at_once: int):
    """Of each block its distinct bigrams and words with their counts, a row for each part of the range of hashes; and, if it has texts to
    score, a row of its own with all words in turn, by their rank in the block."""
    bounds = np.array([-(-k * 2**64 // parts) for k in range(1, parts)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(blocks(batches, at_once)):
            number, asked = TaskContext.get().partitionId() << 32 | k, bool(block.asked.any())
            words, before, now = block.bigrams()
            sides = np.repeat(block.sides[:2], block.n, axis=1)
            known, place = np.unique(codes(words, before, now), return_inverse=True)
            held = [(known, sums(place, sides, len(known))), (words, sums(now, sides, len(words)) + sums(before, sides, len(words)))]
            ends = [[0, *np.searchsorted(keys, bounds), len(keys)] for keys, _ in held]
            rows = []
            for part in range(parts):
                cuts = [slice(e[part], e[part + 1]) for e in ends]
                if any(c.start < c.stop for c in cuts):
                    bodies = [squeezed(steps(keys[c]), *(x[c] for x in counts)) for c, (keys, counts) in zip(cuts, held, strict=True)]
                    rows.append({"dealt": part, "block": number, "asked": asked, "bigrams": bodies[0], "words": bodies[1]})
            if asked:
                times = np.bincount(now, minlength=len(words))
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                texts = squeezed(block.n, block.keys, block.asked)
                rows.append({"dealt": -1 - number, "block": number, "ids": squeezed(rank[now]), "times": squeezed(times), "texts": texts})
            yield pa.RecordBatch.from_pylist(rows, schema=DEALT)

    return run


def _counted(group: pa.Table) -> pa.Table:
    """To each block's bigrams and words of one part of the hashes their counts in all blocks, in the block's order."""
    if group["dealt"][0].as_py() < 0:
        return group.append_column("part", pa.array([-1] * len(group), pa.int64())).select(COUNTED.names)
    rows = group.select(["dealt", "block", "asked", "bigrams", "words"]).to_pylist()
    out = [{"block": r["block"], "part": r["dealt"]} for r in rows]
    for name, columns in (("bigrams", 3), ("words", 5)):
        held = [opened(r[name], columns) for r in rows]
        keys = [np.cumsum(h[0].view(np.uint64), dtype=np.uint64) for h in held]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.array(sums(place, np.concatenate([h[1:] for h in held], axis=1), len(known)))
        firsts = np.cumsum([0, *map(len, keys)])
        for r, own, start, end in zip(out, held, firsts, firsts[1:]):
            found = totals[:, place[start:end]]
            r[name] = squeezed(*found) if name == "bigrams" else squeezed(own[0], *found)
    return pa.Table.from_pylist([o for o, r in zip(out, rows, strict=True) if r["asked"]], schema=COUNTED)


def _block_losses(totals: list[int], n_words: int, prior: float):
    def run(group: pa.Table) -> pa.Table:
        own, *parts = group.sort_by("part").to_pylist()
        counts = np.concatenate([opened(r["bigrams"], 2) for r in parts], axis=1)
        held = [opened(r["words"], 5) for r in parts]
        words = np.concatenate([np.cumsum(h[0].view(np.uint64), dtype=np.uint64) for h in held])
        alone, first = np.split(np.concatenate([h[1:] for h in held], axis=1), 2)
        n, keys, asked = opened(own["texts"], 3)
        order = np.argsort(-opened(own["times"], 1)[0], kind="stable")
        before, now = followed(order[opened(own["ids"], 1)[0]], n)
        _, index, place = np.unique(codes(words, before, now), return_index=True, return_inverse=True)
        text, losses = np.repeat(np.arange(len(n)), n), []
        for seen, one, follows, total in zip(counts, alone, first, totals, strict=True):
            given = (seen + prior * ((one + 1) / (total + n_words + 1))[now[index]]) / (follows[before[index]] + prior)
            losses.append(np.bincount(text, weights=-np.log(given)[place], minlength=len(n)) / np.maximum(n, 1))
        return pa.table([pa.array(x[asked > 0]) for x in (keys, n, *losses)], names=["met", *RESULTS[:3]])

    return run


def score_against(
    docs: DataFrame, target: DataFrame, background: DataFrame, text: str = "text", prior: float = PRIOR, share: float = PAIR_SHARE,
    at_once: int = COUNTED_AT_ONCE,
) -> DataFrame:
    """As ``score``, under models of all words and all bigrams of both tables, however rare.

    Texts are taken in blocks of about ``at_once`` words. Each block sends its distinct words and bigrams, by hash, to tasks that add up
    all blocks, and gets back their counts. No key is skewed: a bigram goes out once a block, however often it stands there. A text is
    never split, so the longest one sets what a task holds. Words, bigrams and texts are told apart by 64-bit hashes. ``share`` is for
    callers from when common bigrams were sent to every task; it changes nothing.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")
    tables = [(target, "t"), (background, "b")] + ([] if docs is background or docs is target else [(docs, "o")])
    marks = [(df, df is docs, [F.lit(int(s == side)).cast("long").alias(s) for s in SIDES]) for df, side in tables]
    texts = reduce(DataFrame.unionByName, [df.select(body, F.lit(asked).alias("asked"), *mark) for df, asked, mark in marks])
    texts = texts.select(F.xxhash64("text").alias("key"), "*")
    counted = texts.mapInArrow(_word_counts(at_once), "word long, t long, b long, o long")
    counted = counted.groupBy("word").agg(*[F.sum(s).alias(s) for s in SIDES])
    n_words, *totals = counted.agg(F.count(F.when(F.col("t") + F.col("b") > 0, 1)), *[F.coalesce(F.sum(s), F.lit(0)) for s in SIDES]).first()
    parts = max(1, -(-sum(totals) // at_once))
    dealt = texts.mapInArrow(_dealt(parts, at_once), "dealt long, block long, asked boolean, " + BODIES)
    known = dealt.groupBy("dealt").applyInArrow(_counted, "block long, part long, " + BODIES)
    found = known.groupBy("block").applyInArrow(_block_losses(totals[:2], n_words, prior), "met long, " + SCHEMA.rpartition(",")[0])
    found = found.groupBy("met").agg(*[F.max(c).alias(c) for c in RESULTS[:3]])  # equal texts have equal results
    rows = packed(docs, F.xxhash64(body).alias("_key")).join(found, F.col("_key") == F.col("met"), "left")
    made = rows.select(ROW, *RESULTS[:3], (F.col("target_loss") - F.col("background_loss")).alias("score"))
    return unpacked(made, docs.columns, RESULTS)


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """The target are the benchmark's passages, the background all documents."""
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_against(docs, table(spark, folder, "benchmark"), docs).select("doc_id", *RESULTS)
