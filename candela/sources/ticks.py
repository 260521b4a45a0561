"""Ticks to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]


def make_bars(
    ticks: DataFrame,
    step: int,
    ticker: str,
    ts: str,
    price: Column,
    volume: Column,
    ties: Sequence[str] = (),
) -> DataFrame:
    """OHLCV bars of ``step`` seconds: first, max, min and last price, summed volume.

    One hash-partitioned aggregate with map-side combine, so a ticker that holds most ticks is reduced
    before the shuffle. ``ties`` makes the tick order total when timestamps repeat.
    """
    order = F.struct(ts, *ties) if ties else F.col(ts)
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    bar = F.timestamp_seconds(F.floor(second / F.lit(step)) * F.lit(step))
    return ticks.groupBy(F.col(ticker).alias("ticker"), bar.alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        volume.alias("volume"),
    )


def event_bars(spark: SparkSession, folder: str, step: int = 3_600) -> DataFrame:
    """Bars of the ``events`` table: one series per event type, price and volume from ``value``."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return make_bars(
        events, step, "event_type", "ts", F.col("value"), F.round(F.sum("value"), 2)
    )


def trade_bars(spark: SparkSession, folder: str, step: int = 86_400) -> DataFrame:
    """Daily bars of ``lineitem``: one series per return flag, unit price, summed quantity."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    return make_bars(
        items,
        step,
        "l_returnflag",
        "l_shipdate",
        F.col("l_extendedprice") / F.col("l_quantity"),
        F.sum("l_quantity"),
        ties=("l_orderkey", "l_linenumber", "l_partkey"),
    )
