"""Document fingerprints by SimHash, and the search for fingerprints within a Hamming radius.

Each pair of neighbouring words is a term, weighted by how often it occurs. Its 128 hash bits vote with that weight for or against each
bit of the fingerprint. For the search, fingerprints are cut into one block more than the radius: two within the radius agree in a
block at least, so tables with a block in front, joined on it, hold all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from candela.llm.columns import packed, quoted, unpacked
from candela.llm.hashing import mixed, portions, shingle_hashes, word_hashes
from candela.llm.language import small_batches
from candela.llm.registry import query, table

BITS = 128
TERM_WORDS = 2
SECOND = np.uint64(0xD6E8FEB86659FD93)
NEIGHBOURS, MOST_STRETCHES = 512, 100_000


def fingerprints(texts: list[str | None]) -> list[str]:
    """32 hex digits for each text; null and wordless texts have 0."""
    texts = ["" if t is None else t for t in texts]
    return [f for part in portions(texts, 400_000) for f in _fingerprints(texts[part])]


def _fingerprints(texts: list[str]) -> list[str]:
    words, firsts = word_hashes(texts)
    terms, at = shingle_hashes(words, firsts, TERM_WORDS)
    out = np.zeros((len(texts), BITS), dtype=bool)
    full = np.flatnonzero(np.diff(at))
    if len(full):  # a term is 128 votes
        pair = np.column_stack([terms, mixed(terms ^ SECOND)]).view(np.uint8).reshape(-1, 16)
        votes = np.add.reduceat(np.unpackbits(pair, axis=1), at[full], axis=0, dtype=np.int64)
        out[full] = 2 * votes > np.diff(at)[full][:, None]
    return [b.tobytes().hex() for b in np.packbits(out, axis=1)]


@F.pandas_udf(StringType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The SimHash of a text column."""
    for texts in batches:
        yield pd.Series(fingerprints(texts.tolist()), dtype=object)


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    halves = [
        F.bit_count(F.conv(F.substring(a, k, 16), 16, -10).cast("long").bitwiseXOR(F.conv(F.substring(b, k, 16), 16, -10).cast("long")))
        for k in (1, 17)
    ]
    return halves[0] + halves[1]


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the angle that the distance stands for, 0 at the least: 1 for equal texts, about 0 for unrelated ones."""
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(distance(a, b) * (np.pi / BITS))))


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document with its ``fingerprint``. Null texts count as empty and have the fingerprint 0, as wordless texts do. Equal texts
    have equal fingerprints; repeated rows stay; an empty table gives an empty result. An input column named ``fingerprint`` is
    replaced, all others are kept."""
    rows = packed(docs, fingerprint(F.col(quoted(text))).alias("fingerprint"))
    return unpacked(rows, docs.columns, ["fingerprint"])


def near_pairs(docs: DataFrame, radius: int = 3, queries: Column | None = None) -> DataFrame:
    """All pairs of different fingerprints at most ``radius`` apart: ``a``, ``b`` (a < b) and ``distance``.

    ``docs`` has ``fingerprint``; copies share one, so a group of copies is one row here and its members follow by a join on it. With
    ``queries`` (a condition on docs) one of the two fingerprints belongs to a row that meets it. Null fingerprints pair with nothing.
    """
    blocks = radius + 1
    cuts = [round(k * 32 / blocks) for k in range(blocks + 1)]
    if cuts[1] < 1 or radius >= 32:
        raise ValueError("the radius must be below 32")
    is_query = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    known = (
        docs.filter("fingerprint IS NOT NULL").select("fingerprint", is_query.alias("q")).groupBy("fingerprint").agg(F.max("q").alias("q"))
    )
    keys = F.array(*[F.substring("fingerprint", cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in range(blocks)])
    tables = known.select("fingerprint", "q", F.posexplode(keys).alias("block", "bits"))
    left, right = tables.filter("q").alias("l"), tables.alias("r")
    met = left.join(right, ["block", "bits"]).filter("l.fingerprint <> r.fingerprint")
    if queries is None:
        met = met.filter("l.fingerprint < r.fingerprint")
    a, b = F.least("l.fingerprint", "r.fingerprint"), F.greatest("l.fingerprint", "r.fingerprint")
    near = met.select(a.alias("a"), b.alias("b"), distance(F.col("l.fingerprint"), F.col("r.fingerprint")).alias("distance"))
    return near.filter(F.col("distance") <= radius).distinct()


def with_next(docs: DataFrame, key: str, carried: list[str], derive: Callable[[DataFrame], DataFrame], derived: list[str]) -> DataFrame:
    """Every row after ``derive`` (which adds the ``derived`` columns), with ``next_<c>`` of the carried and derived columns: those of
    the row with the next key, and after the last those of the first.

    Keys are cut into stretches of about ``NEIGHBOURS`` rows, so rows move once; the first rows of the stretches, at most
    ``MOST_STRETCHES``, tell each stretch what follows it. Equal keys follow one another in the order of the carried columns.
    """
    facts = docs.agg(F.min(key), F.max(key), F.count(key)).first()
    low, high, n = facts[0] or 0, facts[1] or 0, facts[2] or 0
    stretches = min(MOST_STRETCHES, max(1, n // NEIGHBOURS))
    width = max(1, ceil((high - low + 1) / stretches))
    stretch = F.coalesce(F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    rows = docs.withColumn("_stretch", stretch)
    # One row for each stretch, at most MOST_STRETCHES and one for null keys: its first key, and the stretch before it.
    firsts = rows.groupBy("_stretch").agg(F.min(key).alias("_first"))
    before = F.coalesce(F.lag("_stretch").over(Window.orderBy("_stretch")), F.max("_stretch").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.select(F.col("_stretch"), "_first", before.alias("_before"))
    heads = (
        rows.join(F.broadcast(firsts), ["_stretch"])
        .filter(F.col(key).eqNullSafe(F.col("_first")))
        .groupBy("_before").agg(F.min(F.struct(key, *carried)).alias("_head"))
        .select(F.col("_before").alias("_stretch"), *[F.col(f"_head.{c}").alias(c) for c in (key, *carried)])
    )
    every = [*carried, *derived]
    heads = derive(heads).select("_stretch", *[F.col(c).alias(f"_head_{c}") for c in every])
    w = Window.partitionBy("_stretch").orderBy(key, *carried)
    led = derive(rows).select(
        "*", F.lead(F.lit(True)).over(w).alias("_more"), *[F.lead(c).over(w).alias(f"_lead_{c}") for c in every]
    )
    nexts = [F.when(F.col("_more"), F.col(f"_lead_{c}")).otherwise(F.col(f"_head_{c}")).alias(f"next_{c}") for c in every]
    return led.join(heads, "_stretch", "left").select(*docs.columns, *derived, *nexts)


@query("op4_document_fingerprints")
def op4_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"], with_fingerprint, ["fingerprint"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    made = made.select("*", fingerprint("edited").alias("edited_fingerprint"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
