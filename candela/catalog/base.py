"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

# Queries whose ``date`` is a calendar day: shown as text, which both engines print alike.
BY_DAY = {
    "capped_weights", "daily_accounting", "daily_accounting_with_commission", "daily_returns_filled", "kelly_weights",
    "largest_weight_change",
    "latest_signal_per_day", "market_regime", "mean_confidence_per_day", "money_allocation", "result_files_round_trip",
    "threshold_rebalance_step", "threshold_rebalance_walk", "top_allocations", "top_three_allocations",
    "trailing_year_slices", "weights_for_universe", "weights_times_next_returns",
}

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its own tests speak for it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = fn(spark, folder)
            return out.withColumn("date", F.col("date").cast("string")) if name in BY_DAY else out

        QUERIES[name] = in_utc
        if sql is not None:
            SQL[name] = f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({sql})" if name in BY_DAY else sql
        return fn

    return add


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines print the same value; no negative zero."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = (F.round(c, digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long").alias(f.name)
        fields.append(c)
    return df.select(*fields)


def with_ctes(*parts: str, recursive: bool = False) -> str:
    """``WITH`` the given CTEs, the last part being the final select."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1]


# Hourly bars of the events table, and daily bars of the trades table, with bar numbers.
B = """
b0 AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 2) AS volume FROM events GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS pos FROM b0)"""

D = """
d0 AS (SELECT l_returnflag AS ticker, date_trunc('day', l_shipdate) AS ts,
  arg_min(l_extendedprice / l_quantity, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey}) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey}) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS pos FROM d0)"""


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def ewm_cte(name: str, source: str, x: str, alpha: float, at_least: int) -> str:
    """Exponentially weighted mean by its definition: every row against all earlier rows."""
    w = f"pow({1 - alpha!r}, a.pos - c.pos)"
    return f"""{name} AS (SELECT a.ticker, a.pos, CASE WHEN count(c.{x}) >= {at_least} THEN
  sum(c.{x} * {w}) / sum(CASE WHEN c.{x} IS NOT NULL THEN {w} END) END AS v
  FROM {source} a JOIN {source} c ON a.ticker = c.ticker AND c.pos <= a.pos GROUP BY 1, 2)"""


def ewmstd_cte(name: str, source: str, x: str, alpha: float, at_least: int) -> str:
    """Exponentially weighted sample deviation, bias-corrected, around the weighted mean."""
    w = f"pow({1 - alpha!r}, a.pos - c.pos)"
    mean = ewm_cte(f"{name}_m", source, x, alpha, 1)
    return f"""{mean},
{name} AS (SELECT a.ticker, a.pos, CASE WHEN count(c.{x}) >= {at_least} AND count(c.{x}) > 1 THEN
  sqrt(sum({w} * pow(c.{x} - m.v, 2)) / sum(CASE WHEN c.{x} IS NOT NULL THEN {w} END)
  * pow(sum(CASE WHEN c.{x} IS NOT NULL THEN {w} END), 2) / (pow(sum(CASE WHEN c.{x} IS NOT NULL THEN {w} END), 2)
  - sum(CASE WHEN c.{x} IS NOT NULL THEN {w} * {w} END))) END AS v
  FROM {source} a JOIN {source} c ON a.ticker = c.ticker AND c.pos <= a.pos
  JOIN {name}_m m ON m.ticker = a.ticker AND m.pos = a.pos GROUP BY 1, 2)"""
