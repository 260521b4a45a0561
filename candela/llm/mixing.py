"""Interleave sources by Pfair scheduling, so that each prefix of the result holds every source in its target share.

A source with weight w gets a release time and a deadline for each of its blocks: block i (from 0) is released at slot floor(i / w) and
due before slot ceil((i + 1) / w). Earliest deadline first then keeps every source less than one block from its share at any time.
Weights are whole parts of a cycle, so the schedule repeats: one cycle is scheduled in one row, and each block finds its slot by its
number. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.llm.columns import ROW, packed, quoted, unpacked
from candela.llm.registry import query, table

CYCLE = 2000  # slots after which the schedule repeats
BLOCK = 64  # documents of a source that stay together
DIGITS = 3  # hex digits of the hash that part a source's documents: 4096 stretches
RESULTS = ["block", "release", "deadline", "slot", "position"]


def target_weights(docs: DataFrame, source: str = "source", power: float = 0.5) -> DataFrame:
    """``source`` and ``weight``: each source's number of documents to the given power. Below 1, small sources gain."""
    counts = docs.groupBy(F.col(quoted(source)).alias("source")).count()
    return counts.select("source", F.pow(F.col("count"), F.lit(power)).alias("weight"))


def shares(weights: DataFrame, cycle: int = CYCLE) -> tuple[DataFrame, int]:
    """``source``, ``parts`` and ``number`` (1, 2, ... by name), and the cycle: the parts are whole, at least 1, and sum to the cycle.

    Each source gets one part, and the largest remainders of its share of the rest decide. The cycle is ``cycle``, or twice the number
    of sources if that is more. A null source is a source of its own; a source without a positive weight is an error.
    """
    known = weights.groupBy("source").agg(F.sum("weight").alias("weight"))
    facts = known.agg(F.count(F.lit(1)), F.sum("weight"), F.count(F.when(~(F.col("weight") > 0) | F.col("weight").isNull(), 1))).first()
    n, total, bad = facts
    if bad:
        raise ValueError(f"{bad} sources have no positive weight")
    cycle = max(cycle, 2 * n)
    exact = F.col("weight") / F.lit(total or 1.0) * (cycle - n)
    base = known.select("source", (F.floor(exact) + 1).alias("base"), F.round(exact - F.floor(exact), 9).alias("rest"))
    # One row for each source: these windows see the sources, not the documents.
    ranked = base.select(
        "source", "base",
        F.row_number().over(Window.orderBy(F.desc("rest"), F.asc_nulls_first("source"))).alias("rank"),
        F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))).alias("number"),
        (F.lit(cycle) - F.sum("base").over(Window.partitionBy(F.lit(0)))).alias("left"),
    )
    parts = F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)
    return ranked.select("source", parts.alias("parts"), "number"), cycle


def release(i: Column, parts: Column, cycle: int) -> Column:
    """Slot from which block i may run: floor(i / w), in whole numbers."""
    return F.floor((i * cycle - F.pmod(i * cycle, parts)) / parts).cast("long")


def deadline(i: Column, parts: Column, cycle: int) -> Column:
    """Slot before which block i must have run: ceil((i + 1) / w)."""
    return release(i + 1, parts, cycle) + F.when(F.pmod((i + 1) * cycle, parts) > 0, 1).otherwise(0)


def schedule(parts: DataFrame, cycle: int) -> DataFrame:
    """``source``, ``parts``, ``turn`` (a source's block within the cycle, from 0) and ``at`` (its slot): one cycle.

    Slot after slot, the released block with the earliest deadline is taken; ties go to the source first by name. The row holds one
    number for each source and each slot of the cycle.
    """
    row = parts.agg(F.sort_array(F.collect_list(F.struct("number", "parts", "source"))).alias("s"))
    # Per slot: the next block of each source as (deadline, number) if it is released, and the least of them.
    chosen = f"""array_min(transform(s, (x, k) -> CASE WHEN z.c[k] * {cycle} div x.parts <= t
      THEN named_struct('d', ((z.c[k] + 1) * {cycle} + x.parts - 1) div x.parts, 'k', k) END)).k"""
    folded = f"""aggregate(sequence(0L, {cycle - 1}L),
      named_struct('c', transform(s, x -> 0L), 'o', CAST(array() AS ARRAY<INT>)),
      (z, t) -> transform(array({chosen}), j -> named_struct(
        'c', transform(z.c, (n, k) -> n + CASE WHEN k = j THEN 1L ELSE 0L END), 'o', concat(z.o, array(j))))[0]).o"""
    slots = row.filter(F.size("s") > 0).select("s", F.expr(folded).alias("o"))
    at = slots.select("s", F.posexplode("o").alias("at", "k")).select("at", F.expr("s[k]").alias("x"))
    turn = F.row_number().over(Window.partitionBy("x.number").orderBy("at")) - 1
    return at.select(F.col("x.source").alias("source"), F.col("x.parts").alias("parts"), turn.cast("long").alias("turn"), "at")


def mix(
    docs: DataFrame, weights: DataFrame, key: str = "doc_id", source: str = "source", block: int = BLOCK, cycle: int = CYCLE,
    ties: list[str] | None = None, results: list[str] = RESULTS,
) -> DataFrame:
    """Every row with its ``block`` in its source, the block's ``release``, ``deadline`` and ``slot``, and its ``position``: sorted by
    it, rows are mixed to the target weights.

    Within a source, rows are in the order of their key's MD5, then of the key and ``ties``; ``block`` rows make a block. All rows stay:
    when a source ends, its later positions stay free and the others go on in their shares. A null source is a source of its own, a null
    key is hashed as empty text, repeated rows get positions side by side. A source without a weight is an error; an empty table gives
    an empty result. ``results`` renames the five; input columns named like a result are replaced by it, all others are kept.
    """
    parts, cycle = shares(weights, cycle)
    plan = schedule(parts, cycle)
    hashed = F.md5(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")))
    rows = packed(
        docs, F.col(quoted(source)).alias("_source"), hashed.alias("_hash"), F.substring(hashed, 1, DIGITS).alias("_stretch"),
        *[F.col(quoted(c)).alias(f"_tie{k}") for k, c in enumerate([key, *(ties or [])])],
    )
    # A source's rows are numbered stretch by stretch; only one row for each stretch meets the others of its source.
    counts = rows.groupBy("_source", "_stretch").count()
    before = F.sum("count").over(Window.partitionBy("_source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_source").alias("_s"), F.col("_stretch").alias("_t"), F.coalesce(before, F.lit(0)).alias("_before"))
    order = Window.partitionBy("_source", "_stretch").orderBy("_hash", *[c for c in rows.columns if c.startswith("_tie")])
    numbered = rows.withColumn("_n", F.row_number().over(order) - 1)
    numbered = numbered.join(counts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_stretch") == F.col("_t")))
    number = F.col("_before") + F.col("_n")
    blocks = numbered.select(
        "*", F.floor(number / block).cast("long").alias("block"), F.pmod(number, F.lit(block)).cast("long").alias("_in")
    )
    # The plan has a row for each slot of a cycle: cycle is at least 2000, at most twice the number of sources beyond that.
    plan = plan.select(F.col("source").alias("_ps"), "parts", "turn", "at")
    met = blocks.join(parts.select(F.col("source").alias("_ws"), F.col("parts").alias("_parts")), F.col("_source").eqNullSafe(F.col("_ws")), "left")
    met = met.withColumn("_parts", F.coalesce("_parts", F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("_source", F.lit("null"))))))
    met = met.join(
        plan, F.col("_source").eqNullSafe(F.col("_ps")) & (F.pmod(F.col("block"), F.col("_parts")) == F.col("turn"))
    )
    slot = F.floor(F.col("block") / F.col("parts")) * cycle + F.col("at")
    placed = met.select(
        "*",
        release(F.col("block"), F.col("parts"), cycle).alias("release"),
        deadline(F.col("block"), F.col("parts"), cycle).alias("deadline"),
        slot.cast("long").alias("slot"),
        (slot * block + F.col("_in")).cast("long").alias("position"),
    )
    named = placed.select(ROW, *[F.col(c).alias(n) for c, n in zip(RESULTS, results, strict=True)])
    return unpacked(named, docs.columns, results)


@query(
    "op10_mixing",
    f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1),
e AS (SELECT source, sqrt(docs) / sum(sqrt(docs)) OVER () * (greatest({CYCLE}, 2 * count(*) OVER ()) - count(*) OVER ()) AS x,
  greatest({CYCLE}, 2 * count(*) OVER ()) AS cycle FROM n),
b AS (SELECT source, cycle, CAST(floor(x) AS BIGINT) + 1 AS base, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC,
  source NULLS FIRST) AS rank, row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM e),
p AS (SELECT source, k, cycle, base + CASE WHEN rank <= cycle - sum(base) OVER () THEN 1 ELSE 0 END AS parts FROM b),
s AS (SELECT list(CAST(parts AS BIGINT) ORDER BY k) AS q, CAST(max(cycle) AS BIGINT) AS cycle FROM p),
r AS (SELECT 0::BIGINT AS t, list_transform(q, lambda x: 0::BIGINT) AS c, 0::BIGINT AS j FROM s
  UNION ALL
  SELECT t + 1, list_transform(c, lambda n, i: n + CASE WHEN i = j2 THEN 1 ELSE 0 END), j2 FROM (
    SELECT t, c, list_min(list_transform(c, lambda n, i: CASE WHEN n * cycle // q[i] <= t
      THEN ((n + 1) * cycle + q[i] - 1) // q[i] * 1000000 + i ELSE 9000000000000000 END)) % 1000000 AS j2, cycle FROM r, s) WHERE t < cycle),
plan AS (SELECT j, t - 1 AS place_at, row_number() OVER (PARTITION BY j ORDER BY t) - 1 AS turn FROM r WHERE t > 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
  NULLS FIRST) - 1 AS i FROM documents),
m AS (SELECT doc_id, d.source, i % {BLOCK} AS place, i // {BLOCK} AS block, parts, k, cycle FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, block, CAST(block * cycle // parts AS BIGINT) AS release,
  CAST(((block + 1) * cycle + parts - 1) // parts AS BIGINT) AS deadline, CAST(block // parts * cycle + place_at AS BIGINT) AS slot,
  CAST((block // parts * cycle + place_at) * {BLOCK} + place AS BIGINT) AS position FROM m JOIN plan ON j = k AND turn = block % parts""",
)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mix(docs, target_weights(docs))
