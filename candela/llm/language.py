"""Language by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is cut from labelled texts. A text is cut into pieces, every piece is
compressed with each dictionary, and the sums of the sizes decide; the relative margin to the second says how sure that is. If it
is small, a higher compression level decides. Only letters count: marks, digits and case are flattened first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.columns import ROW, packed, quoted, unpacked
from candela.llm.registry import held_out, query, table

UNKNOWN = "und"
RESULTS = ["lang_pred", "score", "margin", "rejected"]
SCHEMA = "lang_pred string, score double, margin double, rejected boolean"


NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return NO_LETTERS.sub(" ", text.lower()).strip()


@dataclass
class LanguageModel:
    """One dictionary text for each language, and how texts are compared with them.

    ``level``: zstandard's level; margins below ``unsure`` are decided by ``careful_level``. ``narrow``: a margin below it is rejected
    and scores under 0.5. ``steep``: how fast the score grows with the margin.
    """

    texts: dict[str, bytes]
    level: int = 5
    careful_level: int = 12
    piece: int = 4096
    unsure: float = 0.06
    narrow: float = 0.005
    steep: float = 60.0
    _coders: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_coders": {}}

    def coders(self, level: int) -> list[zstandard.ZstdCompressor]:
        """A compressor for each language, in the order of their names."""
        if level not in self._coders:
            made = []
            for _, content in sorted(self.texts.items()):
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=level)
                made.append(
                    zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_dict_id=False)
                )
            self._coders[level] = made
        return self._coders[level]

    def smallest(self, body: bytes, level: int) -> tuple[str, float]:
        """The language whose dictionary makes the text smallest, and the margin: how much larger the second is."""
        names, sums = sorted(self.texts), [0] * len(self.texts)
        for at in range(0, len(body), self.piece):
            part = body[at : at + self.piece]
            for k, coder in enumerate(self.coders(level)):
                sums[k] += len(coder.compress(part))
        size, name = min(zip(sums, names, strict=True))
        others = [s for s, n in zip(sums, names, strict=True) if n != name]
        return name, 1 - size / min(others) if others else 1.0

    def classify(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin, rejected. ``und`` for null and for texts without a letter, or if nothing was learned."""
        if not self.texts or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        body = letters(text).encode("utf-8", "replace")
        name, margin = self.smallest(body, self.level)
        if margin < self.unsure:
            name, margin = self.smallest(body, self.careful_level)
        return name, 1 / (1 + exp(-self.steep * (margin - self.narrow))), margin, margin < self.narrow


def fit(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", samples: int = 64, chars: int = 2048,
    max_languages: int = 256, **settings,
) -> LanguageModel:
    """A model from labelled rows (text and language not null).

    The dictionaries come from a bounded sample: at most ``samples`` texts a language, those with the least hash in each of as many
    hash buckets, and ``chars`` characters of each, taken from its middle. So at most samples * chars * max_languages characters
    reach the driver; more languages than ``max_languages`` are an error. Without labelled rows the model knows no language.
    """
    body = F.col(quoted(text))
    mixed = F.xxhash64(F.col(quoted(key)))
    middle = F.substring(body, F.greatest(F.lit(1), (F.char_length(body) / 2).cast("int") - chars // 2), F.lit(chars))
    pieces = (
        docs.filter(body.isNotNull() & F.col(quoted(lang)).isNotNull() & (F.trim(body) != ""))
        .select(F.col(quoted(lang)).alias("lang"), F.pmod(mixed, F.lit(samples)).alias("bucket"),
                F.struct(mixed.alias("hash"), middle.alias("part")).alias("one"))
        .groupBy("lang", "bucket").agg(F.min("one").alias("one"))
    )
    rows = pieces.select("lang", "bucket", "one.part").limit(samples * max_languages + 1).collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.bucket)):
        texts.setdefault(row.lang, []).append(letters(row.part))
    if len(texts) > max_languages or len(rows) > samples * max_languages:
        raise ValueError(f"more than {max_languages} languages: {len(texts)}")
    return LanguageModel({k: "\n".join(v).encode("utf-8", "replace") for k, v in texts.items()}, **settings)


def classified(model: LanguageModel, text: Column) -> Column:
    """``lang_pred``, ``score``, ``margin`` and ``rejected`` of a text column as one struct."""

    @F.pandas_udf(SCHEMA)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.classify(t) for t in texts], columns=RESULTS)

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", results: list[str] = RESULTS) -> DataFrame:
    """Every document with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, and rejected. Repeated rows stay, each judged alike; ties
    between languages go to the first name, and are rejected as narrow; empty tables give empty results. ``results`` renames the four;
    input columns named like a result are replaced by it, all others are kept.
    """
    rows = packed(docs, classified(model, F.col(quoted(text))).alias("found"))
    return unpacked(rows.select(ROW, *[F.col(f"found.{c}").alias(n) for c, n in zip(RESULTS, results, strict=True)]), docs.columns, results)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what a Python task holds at once: long texts come in batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fit_on_learned_part(docs: DataFrame) -> LanguageModel:
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents")
    model = fit_on_learned_part(docs.select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
