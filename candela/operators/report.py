"""Tables for a reader of daily results ``(profile, date, portfolio_value, benchmark_value, allocations, ...)``.

One row per profile and day: windows here are as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _by_day():
    return Window.partitionBy("profile").orderBy("date")


def shares(results: DataFrame, column: str) -> DataFrame:
    """Days and percent per value of ``column``, most days first."""
    counts = results.groupBy("profile", F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("days"))
    total = F.sum("days").over(Window.partitionBy("profile"))
    return counts.withColumn("pct", F.round(F.col("days") / total * 100).cast("long")).orderBy("profile", F.desc("days"), "name")


def label(name: Column | str) -> Column:
    return F.initcap(name)


def summary(results: DataFrame, periods: int = 252) -> DataFrame:
    """Total return, distance to the benchmark, profit, drawdown, Sharpe ratio and mean confidence."""
    value = F.col("portfolio_value")
    steps = results.withColumn("_r", F.try_divide(value, F.lag(value).over(_by_day())) - 1).withColumn(
        "_peak", F.max(value).over(_by_day().rowsBetween(Window.unboundedPreceding, 0))
    )
    first = lambda c: F.min_by(c, "date")
    last = lambda c: F.max_by(c, "date")
    gain = lambda c: (F.try_divide(last(c), first(c)) - 1) * 100
    spread = F.stddev_pop("_r")
    return steps.groupBy("profile").agg(
        F.count(F.lit(1)).alias("days"),
        gain("portfolio_value").alias("total_return"),
        (gain("portfolio_value") - gain("benchmark_value")).alias("vs_benchmark"),
        (last("portfolio_value") - first("portfolio_value")).alias("profit"),
        (F.min(F.try_divide(value - F.col("_peak"), "_peak")) * 100).alias("max_drawdown"),
        F.coalesce(F.try_divide(F.avg("_r"), spread) * F.sqrt(F.lit(float(periods))), F.lit(0.0)).alias("sharpe"),
        F.avg("confidence").alias("mean_confidence"),
    )


def asset_names(results: DataFrame) -> DataFrame:
    """All names that occur in the allocation maps, sorted."""
    return results.select(F.explode(F.map_keys("allocations")).alias("asset")).distinct().orderBy("asset")


def chart_rows(results: DataFrame, assets: Sequence[str], scale: float = 25.0) -> DataFrame:
    """One column per asset in percent, scaled and rounded money, month key and day number."""
    share = lambda a: (F.coalesce(F.try_element_at("allocations", F.lit(a)), F.lit(0.0)) * 100).alias(a)
    return results.select(
        "profile",
        F.row_number().over(_by_day()).alias("day"),
        F.round(F.col("portfolio_value") * scale).alias("portfolio"),
        F.round(F.col("benchmark_value") * scale).alias("benchmark"),
        F.date_format("date", "yyyy-MM").alias("month"),
        *[share(a) for a in assets],
    )


def every_tenth(rows: DataFrame, every: int = 10) -> DataFrame:
    """Every n-th day and the last."""
    end = F.max("day").over(Window.partitionBy("profile"))
    return rows.withColumn("_end", end).filter(((F.col("day") - 1) % every == 0) | (F.col("day") == F.col("_end"))).drop("_end")


def top_allocations(results: DataFrame, k: int = 5, above: float = 0.005) -> DataFrame:
    """The k largest allocations of each day above a limit."""
    rows = results.select("profile", "date", F.explode("allocations").alias("asset", "weight")).filter(F.col("weight") > above)
    ranked = Window.partitionBy("profile", "date").orderBy(F.desc("weight"), "asset")
    return rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def last_allocations(results: DataFrame) -> DataFrame:
    """Allocations of the last day in percent with one digit, above 0.1, largest first."""
    last = results.groupBy("profile").agg(F.max_by("allocations", "date").alias("_a"))
    rows = last.select("profile", F.explode("_a").alias("name", "_w")).withColumn("value", F.round(F.col("_w") * 100, 1)).drop("_w")
    return rows.filter(F.col("value") > 0.1).orderBy("profile", F.desc("value"), "name")


def after_fee(results: DataFrame, capital: float, fee_rate: float) -> DataFrame:
    """Values scaled to a starting capital, the fee on gains, and what is left."""
    start = F.first("portfolio_value").over(_by_day().rowsBetween(Window.unboundedPreceding, 0))
    value = F.try_divide(F.lit(float(capital)) * F.col("portfolio_value"), start)
    fee = F.greatest(F.lit(0.0), F.col("value") - capital) * fee_rate
    return results.select("profile", F.row_number().over(_by_day()).alias("day"), value.alias("value")).withColumn(
        "fee", fee
    ).withColumn("net", F.col("value") - F.col("fee"))


def train_against_test(trained: DataFrame, tested: DataFrame) -> DataFrame:
    """Cross-validation metrics per profile and ticker beside the profile's backtest metrics."""
    prefix = lambda df, p, keep: df.select(*keep, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keep])
    return prefix(trained, "train", ["profile", "ticker"]).join(prefix(tested, "test", ["profile"]), "profile", "left")
