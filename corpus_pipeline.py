"""From raw documents to packed training sequences; each stage applies one operator of ``candela.llm`` to all its predecessor kept.

Toxic documents go, then documents without a clear language, then all but one of each group of near duplicates. The rest is mixed to
target weights and stored in that order, and packed in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import jaccard_join, language, mixing, packing, toxicity
from candela.session import checkpointed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows, does not reject."""
    language.small_batches(spark)
    model = toxicity.fit_on_learned_part(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = toxicity.judge(docs, model, results=["_score", "_hits", "_rejected"])
    return judged.filter(~F.col("_rejected")).select(*docs.columns)


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression model, fitted on the labelled rows, tells with some margin."""
    language.small_batches(spark)
    model = language.fit_on_learned_part(docs)
    found = language.identify(docs, model, results=["_lang", "_score", "_margin", "_rejected"])
    return found.filter(~F.col("_rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more connect: the one with the least doc_id."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mix: sources in proportion to the square roots of their sizes."""
    mixed = mixing.mix(docs, mixing.target_weights(docs), ties=["text"], results=[f"_{c}" for c in mixing.RESULTS])
    return mixed.orderBy("_position").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences, in the order of the mix."""
    return packing.pack_in_order(docs, packing.public_tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unclear_language),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Fitted models, tokenizer ids and exact shingle groups are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
