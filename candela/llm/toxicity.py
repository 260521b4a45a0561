"""Toxicity: a lexicon found in misspelled form too, and hits weighed by their context.

The lexicon's trie and the Levenshtein automaton of edit distance one run as one lazily built automaton over a word's letters; a word
leaves it after few letters unless some term is near. Hits inside quotation marks or beside words of reporting count little, hits that
address someone count more. A logistic model turns the hits of a text into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import ROW, packed, quoted, unpacked
from candela.llm.language import small_batches
from candela.llm.registry import held_out, query, table

WORD = re.compile(r"[^\W\d_]+")
SHORTEST_FUZZY = 5  # shorter terms count only as they are spelled
STEMS = (4, 5, 6, 7)
FEWEST_TEXTS = 8  # toxic texts of the sample that must hold a term, however many there are
KNOWN_WORDS = 200_000
# Marks that open or close a quotation, and words of reporting or of address.
QUOTES = "\"“”„«»‘’`"
REPORTING = {"said", "says", "say", "called", "calls", "wrote", "writes", "quote", "quoted", "word", "words", "term", "slur", "insult"}
ADDRESS = {"you", "your", "youre", "ur", "he", "she", "they", "them", "these", "those"}
NEAR = 3  # words on each side of a hit that make its context
QUOTED, ADDRESSED, MISSPELLED = 0.2, 1.2, 0.9  # weights of a hit by context and spelling
RESULTS = ["score", "hits", "rejected"]
SCHEMA = "score double, hits int, rejected boolean"


class FuzzyTrie:
    """A lexicon's trie met with the Levenshtein automaton of distance one.

    A state is the set of (trie node, errors so far) a prefix can have reached; states and steps are made when first needed, and their
    number is bounded by the lexicon, not by the texts. A stem fits any word that begins with it and allows no error.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.child: list[dict[str, int]] = [{}]
        self.whole: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]
        for term in sorted(words):
            node = 0
            for letter in term:
                node = self._grow(node, letter)
                self.fuzzy[node] |= len(term) >= SHORTEST_FUZZY
            self.whole[node] = term
        self.fuzzy[0] = any(len(t) >= SHORTEST_FUZZY for t in words)
        for term in sorted(stems):
            node = 0
            for letter in term:
                node = self._grow(node, letter)
            self.stem[node] = term
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _grow(self, node: int, letter: str) -> int:
        if letter not in self.child[node]:
            self.child[node][letter] = len(self.child)
            self.child.append({})
            self.whole.append(None)
            self.stem.append(None)
            self.fuzzy.append(False)
        return self.child[node][letter]

    def _state(self, reached: set[tuple[int, int]]) -> int:
        for node, errors in list(reached):  # a letter of the term left out
            if errors == 0:
                reached |= {(c, 1) for c in self.child[node].values() if self.fuzzy[c]}
        key = frozenset(reached)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        reached: set[tuple[int, int]] = set()
        for node, errors in self.members[state]:
            if letter in self.child[node]:
                reached.add((self.child[node][letter], errors))
            if errors == 0 and self.fuzzy[node]:
                reached.add((node, 1))  # a letter too many
                reached |= {(c, 1) for c in self.child[node].values() if self.fuzzy[c]}  # another letter
        self.steps[state][letter] = found = self._state(reached) if reached else -1
        return found

    def find(self, word: str) -> tuple[str, int] | None:
        """The term a word stands for and the number of errors: exact words first, then stems, then misspelled words."""
        if word in self.words:
            return word, 0
        state, stem = self.start, None
        for letter in word:
            step = self.steps[state].get(letter)
            state = self._step(state, letter) if step is None else step
            if state < 0:
                break
            for node, errors in self.members[state]:
                if errors == 0 and self.stem[node]:
                    stem = self.stem[node]
        if stem:
            return stem, 0
        if state < 0 or len(word) < SHORTEST_FUZZY - 1:
            return None
        near = [self.whole[n] for n, e in self.members[state] if e and self.whole[n] and len(self.whole[n]) >= SHORTEST_FUZZY]
        return (min(near), 1) if near else None


@dataclass
class ToxicityModel:
    """Terms with their weights, spellings that are ordinary words, and the logistic model over a text's features."""

    words: dict[str, float]
    stems: dict[str, float]
    ordinary: frozenset[str]
    weights: tuple[float, ...] = (-3.0, 4.0, 0.0, 0.0)
    threshold: float = 0.3
    _trie: FuzzyTrie | None = field(default=None, repr=False, compare=False)
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_trie": None, "_known": {}}

    def find(self, word: str) -> tuple[str, int] | None:
        if self._trie is None:
            self._trie = FuzzyTrie(self.words, self.stems)
        if word in self._known:
            return self._known[word]
        found = self._trie.find(word)
        if found and found[1] and word in self.ordinary:
            found = None
        if len(self._known) >= KNOWN_WORDS:  # memory stays bounded whatever the texts hold
            self._known.clear()
        self._known[word] = found
        return found

    def hits(self, text: str) -> tuple[list[tuple[str, float]], int]:
        """(term, context weight) of each hit, in order; the number of words."""
        low = text.lower()
        words = WORD.findall(low)
        wanted = {w: f for w in set(words) if (f := self.find(w))}
        if not wanted:
            return [], len(words)
        spans = list(WORD.finditer(low))
        # Marks between words: an odd number so far on the line means that a quotation is open.
        out, opened, end = [], False, 0
        for at, span in enumerate(spans):
            between = low[end : span.start()]
            for mark in between:
                if mark == "\n":
                    opened = False
                elif mark in QUOTES:
                    opened = not opened
            end = span.end()
            found = wanted.get(span.group())
            if not found:
                continue
            around = set(words[max(0, at - NEAR) : at] + words[at + 1 : at + 1 + NEAR])
            closed = opened and any(q in low[end : low.find("\n", end) if "\n" in low[end:] else len(low)] for q in QUOTES)
            weight = MISSPELLED if found[1] else 1.0
            if closed or around & REPORTING:
                weight *= QUOTED
            elif around & ADDRESS:
                weight *= ADDRESSED
            out.append((found[0], weight))
        return out, len(words)

    def features(self, text: str | None) -> tuple[list[float], int]:
        """Log of weighted word hits, evidence of stems against their usual rate, and log length; the number of hits."""
        found, length = self.hits(text or "")
        words = sum(w for t, w in found if t in self.words)
        stems = sum(self.stems[t] * w for t, w in found if t in self.stems)
        return [log1p(words), log1p(stems), log1p(stems) - log1p(length / 50.0) if stems else 0.0], len(found)

    def score(self, text: str | None) -> tuple[float, int]:
        values, n = self.features(text)
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], values, strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z)))), n


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, stem or not, clean texts, toxic texts, occurrences in toxic texts) of each batch of labelled texts."""
    for batch in batches:
        rows: dict[tuple[str, bool], list[int]] = {}
        for text, label in zip(batch["text"], batch["label"], strict=True):
            words = Counter(WORD.findall((text or "").lower()))
            stems: Counter = Counter()
            for w, n in words.items():
                for k in STEMS:
                    if len(w) > k:
                        stems[w[:k]] += n
            for is_stem, counts in ((False, words), (True, stems)):
                for term, n in counts.items():
                    row = rows.setdefault((term, is_stem), [0, 0, 0])
                    row[int(label)] += 1
                    row[2] += n * int(label)
        yield pd.DataFrame(
            [(t, s, *r) for (t, s), r in rows.items()], columns=["term", "is_stem", "clean", "toxic", "n_toxic"]
        )


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = 20_000,
    terms: int = 500, threshold: float = 0.3,
) -> ToxicityModel:
    """A model from labelled documents.

    It is fitted on at most about ``sample`` labelled documents: those with the least hash of their id. Terms and stems are those whose
    share of toxic texts is far above that of clean ones; at most ``terms`` of each kind reach the driver. With no labels, or only one
    kind, the model has no terms and scores every text alike.
    """
    marked = labels.select(F.col(quoted(key)).alias("id"), F.col(quoted(label)).cast("int").alias("label"))
    marked = marked.filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    n = marked.count()
    share = 1.0 if n <= sample else sample / n
    chosen = marked.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(quoted(key)).alias("id"), F.col(quoted(text)).alias("text")).filter("id IS NOT NULL")
    # The text travels only for chosen documents: both sides of this join are a sample's size.
    ids = texts.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    learned = ids.join(chosen, "id").select("text", "label").persist()
    try:
        return _fitted(learned, terms, threshold)
    finally:
        learned.unpersist()


def _fitted(learned: DataFrame, terms: int, threshold: float) -> ToxicityModel:
    totals = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    if len(totals) < 2:
        return ToxicityModel({}, {}, frozenset(), (-3.0, 0.0, 0.0, 0.0), threshold)
    toxic, clean = totals[1], totals[0]
    counted = (
        learned.mapInPandas(
            _term_counts, "term string, is_stem boolean, clean long, toxic long, n_toxic long"
        )
        .groupBy("term", "is_stem")
        .agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "n_toxic")])
    )
    lift = (F.col("toxic") / toxic) / ((F.col("clean") + 0.5) / clean)
    telling = counted.filter((F.col("toxic") >= FEWEST_TEXTS) & (lift >= 5)).withColumn("lift", lift)
    kinds = {}
    for is_stem in (False, True):
        best = telling.filter(F.col("is_stem") == F.lit(is_stem)).orderBy(F.desc("lift"), "term").limit(terms)
        kinds[is_stem] = {r.term: r for r in best.collect()}
    # A word belongs to the lexicon if it hardly occurs in clean texts; what only stems explain stays with them.
    words = {t: log(1 + r.lift) for t, r in kinds[False].items() if r.lift >= 40 and 3 * r.toxic >= r.n_toxic}
    stems = {
        t: log(r.lift)
        for t, r in kinds[True].items()
        if not any(w.startswith(t) for w in words)
    }
    stems = {t: w for t, w in stems.items() if not any(o != t and t.startswith(o) for o in stems)}
    words = {t: w for t, w in words.items() if not any(t.startswith(s) for s in stems)}
    model = ToxicityModel(words, stems, frozenset(), threshold=threshold)
    # Words of the sample's clean texts: no more than the sample holds.
    usual = learned.filter("label = 0").mapInPandas(_near_words(model), "word string").distinct()
    model = ToxicityModel(words, stems, frozenset(r.word for r in usual.collect()), threshold=threshold)
    rows = learned.mapInPandas(_feature_rows(model), "a double, b double, c double, label int").collect()
    return ToxicityModel(words, stems, model.ordinary, _logistic(np.array(rows, dtype=float)), threshold)


def _near_words(model: ToxicityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for text in batch["text"]:
                seen |= {w for w in set(WORD.findall((text or "").lower())) if (f := model.find(w)) and f[1]}
            yield pd.DataFrame({"word": sorted(seen)}, dtype=object)

    return run


def _feature_rows(model: ToxicityModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*model.features(t)[0], int(y)) for t, y in zip(batch["text"], batch["label"], strict=True)]
            yield pd.DataFrame(rows, columns=["a", "b", "c", "label"])

    return run


def _logistic(rows: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a ridge logistic regression by Newton's method."""
    x, y = np.column_stack([np.ones(len(rows)), rows[:, :-1]]), rows[:, -1]
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def scored(model: ToxicityModel, text: Column) -> Column:
    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [model.score(t) for t in texts]
            yield pd.DataFrame(
                {"score": [s for s, _ in rows], "hits": [n for _, n in rows], "rejected": [s >= model.threshold for s, _ in rows]}
            )

    return run(text)


def judge(docs: DataFrame, model: ToxicityModel, text: str = "text", results: list[str] = RESULTS) -> DataFrame:
    """Every document with ``score`` (0 to 1), ``hits`` and ``rejected`` (score at the model's threshold or above).

    Null and empty texts have no hits and get the score of the model's constant. Repeated rows stay, each judged alike; empty tables
    give empty results. ``results`` renames the three; input columns named like a result are replaced by it, all others are kept.
    """
    rows = packed(docs, scored(model, F.col(quoted(text))).alias("found"))
    return unpacked(rows.select(ROW, *[F.col(f"found.{c}").alias(n) for c, n in zip(RESULTS, results, strict=True)]), docs.columns, results)


def fit_on_learned_part(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_on_learned_part(docs, table(spark, folder, "labels"))
    found = judge(docs, model)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.col("rejected").cast("int").alias("predicted"), "hits"
    )
