"""Clean-up, filters and checks on bars and weights."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.scalars import finite
from candela.operators.timeline import BLOCK, bounded, number, running

PRICES = ("open", "high", "low")


def normalise_ohlcv(df: DataFrame) -> DataFrame:
    """Bars with all five columns: adjusted close preferred, missing prices from close, missing volume 0."""
    have = {c.lower().strip().replace(" ", "_"): c for c in df.columns}
    close = [F.col(f"`{have[c]}`") for c in ("adj_close", "close") if c in have]
    if not close:
        raise ValueError("no close column")
    close = close[0]
    out = [F.col(have["ticker"]), F.col(have["ts"])]
    out += [(F.col(f"`{have[c]}`") if c in have else close).cast("double").alias(c) for c in PRICES]
    out.append(close.cast("double").alias("close"))
    out.append((F.col(f"`{have['volume']}`") if "volume" in have else F.lit(0.0)).cast("double").alias("volume"))
    return df.select(*out).dropna("all", subset=[*PRICES, "close", "volume"])


def between(df: DataFrame, start: datetime | None, end: datetime | None, end_is_date: bool = True) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive; a date-only end covers its whole day."""
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        stop = F.lit(end).cast("timestamp")
        df = df.filter(F.col("ts") < stop + F.expr("INTERVAL 1 DAY") if end_is_date else F.col("ts") <= stop)
    return df


def before(df: DataFrame, cutoff: datetime, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) < F.lit(cutoff))


def since(df: DataFrame, cutoff: datetime, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(cutoff))


def drop_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def with_history(df: DataFrame, at_least: int, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Rows of series that have at least so many rows."""
    keys = list(keys)
    enough = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    return df.join(enough.select(*keys), keys, "left_semi")


def clip_outliers(df: DataFrame, column: str, n_std: float = 5.0, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Clip a column to its series' mean ± ``n_std`` sample deviations."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    low, high = F.col("_m") - n_std * F.col("_s"), F.col("_m") + n_std * F.col("_s")
    x = F.col(column)
    return (
        df.join(stats, keys)
        .withColumn(column, F.when(F.col("_s").isNull(), x).otherwise(F.least(F.greatest(x, low), high)))
        .drop("_m", "_s")
    )


def fill(
    df: DataFrame,
    columns: Sequence[str],
    backward: bool = True,
    default: float | None = None,
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
) -> DataFrame:
    """Fill forward, then (``backward``) the leading gap from the first value, then by ``default``."""
    out = running(number(df, keys), {f"_f_{c}": ("last", F.col(c)) for c in columns}, keys, block)
    filled = {c: F.col(f"_f_{c}") for c in columns}
    if backward:
        # Only the rows before a series' first value are still empty, and that value is one per series.
        first = df.groupBy(*keys).agg(
            *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"_b_{c}") for c in columns]
        )
        out = out.join(first, list(keys))
        filled = {c: F.coalesce(v, F.col(f"_b_{c}")) for c, v in filled.items()}
    if default is not None:
        filled = {c: F.coalesce(v, F.lit(default)) for c, v in filled.items()}
    return out.withColumns(filled).drop(*[f"_{p}_{c}" for c in columns for p in "fb"])


def leading_missing(df: DataFrame, column: str, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Number of rows before the first value of each series (all rows if there is none)."""
    keys = list(keys)
    return (
        number(df, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.min(F.when(F.col(column).isNotNull(), F.col("pos"))) - 1, F.count(F.lit(1))).alias(
                "leading_missing"
            )
        )
    )


def bar_steps(bars: DataFrame, keys: Sequence[str] = ("ticker",), block: int = BLOCK) -> DataFrame:
    """``minutes, n``: how often each distance between neighbouring bars occurs in a series."""
    gap = lambda f: {"_gap": (F.unix_seconds("ts") - F.unix_seconds(f.lag("ts"))) / 60.0}
    gaps = bounded(number(bars, keys).select(*keys, "ts", "pos"), [gap], back=1, keys=keys, block=block)
    return (
        gaps.filter(F.col("_gap").isNotNull())
        .groupBy(*keys, F.col("_gap").alias("minutes"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def bar_frequency(bars: DataFrame, keys: Sequence[str] = ("ticker",), block: int = BLOCK) -> DataFrame:
    """Most common bar step in whole minutes (smallest on ties, 1 for a single bar), and its class.

    The class is that of the median step: 5m, 15m, 1h, 4h or 1d.
    """
    keys = list(keys)
    steps = bar_steps(bars, keys, block).groupBy(*keys).agg(
        F.max_by("minutes", F.struct("n", -F.col("minutes"))).alias("_mode"),
        F.percentile("minutes", F.lit(0.5), F.col("n")).alias("_median"),
    )
    m = F.col("_median")
    size = F.when(m <= 5, "5m").when(m <= 15, "15m").when(m <= 60, "1h").when(m <= 240, "4h").otherwise("1d")
    every = bars.groupBy(*keys).agg(F.lit(1).alias("_one"))
    return every.join(steps, keys, "left").select(
        *keys,
        F.coalesce(F.floor("_mode"), F.lit(1)).cast("long").alias("minutes"),
        F.when(m.isNull(), "1h").otherwise(size).alias("size"),
    )


def check_prices(prices: DataFrame, columns: Sequence[str], at_least: int = 10) -> DataFrame:
    """One row per broken rule; empty when prices may be used."""
    nulls = sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))
    facts = prices.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"))
    rules = F.array(
        F.when(F.col("rows") == 0, "no rows"),
        F.when(F.col("rows") < at_least, "too few rows"),
        F.when(F.col("nulls") > 0, "missing prices"),
    )
    return facts.select(F.explode(F.array_compact(rules)).alias("rule"), "rows", "nulls")


def check_weights(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight sets that do not sum to 1 (± 1e-5) or hold a weight below -1e-5."""
    facts = weights.groupBy(*keys).agg(F.sum("weight").alias("total"), F.min("weight").alias("least"))
    return facts.filter((F.abs(F.col("total") - 1) > 1e-5) | (F.col("least") < -1e-5))


def long_only(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tickers with signal +1 in each group, or the whole group where none has it."""
    keys = list(keys)
    any_long = signals.groupBy(*keys).agg(F.max((F.col("signal") == 1).cast("int")).alias("_long"))
    return (
        signals.join(any_long, keys).filter((F.col("_long") == 0) | (F.col("signal") == 1)).drop("_long")
    )


def lookback(df: DataFrame, rows: int, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """The last ``rows`` rows of each series."""
    keys = list(keys)
    numbered = number(df, keys)
    last = numbered.groupBy(*keys).agg(F.max("pos").alias("_last"))
    return numbered.join(last, keys).filter(F.col("pos") > F.col("_last") - rows).drop("_last", "pos")
