"""Triple-barrier labels: which price level does the path after an event touch first?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.operators.indicators import compute, ew_volatility
from candela.operators.timeline import BLOCK, number

INF = float("inf")


def future_paths(
    events: DataFrame, bars: DataFrame, horizon: int | Column, widest: int, keys: Sequence[str] = ("ticker",)
) -> DataFrame:
    """Pair each event (with its bar number ``pos``) with the bars in ``(pos, pos + horizon]``.

    Bars are cut into stretches of ``widest`` rows, and an event is sent to the two stretches its path
    can reach. The join is then an equi-join on (ticker, stretch): no task sees more than one stretch of
    a series, and the pairs formed are at most twice the pairs kept.
    """
    keys = list(keys)
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    width = F.lit(max(widest, 1))
    home = F.floor((F.col("pos") + 1) / width)
    probes = events.withColumn("_until", F.col("pos") + horizon).withColumn(
        "_part", F.explode(F.array_distinct(F.array(home, F.floor(F.col("_until") / width))))
    )
    path = bars.select(
        *keys,
        F.col("pos").alias("path_pos"),
        F.col("ts").alias("path_ts"),
        F.col("close").alias("path_close"),
        F.floor(F.col("pos") / width).alias("_part"),
    )
    return (
        probes.join(path, keys + ["_part"])
        .filter((F.col("path_pos") > F.col("pos")) & (F.col("path_pos") <= F.col("_until")))
        .drop("_part", "_until")
    )


def vertical_barriers(events: DataFrame, bars: DataFrame, bars_ahead: int) -> DataFrame:
    """Events with ``barrier_ts``: the time of the bar ``bars_ahead`` later, or of the last bar."""
    bars = number(bars)
    at = events.join(bars.select("ticker", "ts", "pos"), ["ticker", "ts"])
    last = bars.groupBy("ticker").agg(F.max("pos").alias("_last"))
    target = at.join(last, "ticker").withColumn("_to", F.least(F.col("pos") + bars_ahead, F.col("_last")))
    ends = bars.select("ticker", F.col("pos").alias("_to"), F.col("ts").alias("barrier_ts"))
    return target.join(ends, ["ticker", "_to"]).select("ticker", F.col("ts").alias("event_ts"), "barrier_ts")


def _levels(pt, sl, min_ret: float, side: Column) -> dict[str, Column]:
    """Barrier prices: above and below for a long event, mirrored for a short one; a multiplier of 0
    removes its barrier."""
    pt, sl = (F.lit(float(m)) if isinstance(m, (int, float)) else m for m in (pt, sl))
    long = side >= 0
    sign = F.when(long, 1.0).otherwise(-1.0)
    return {
        "pt_level": F.when(pt > 0, F.col("entry") * (1 + sign * (pt * F.col("sigma") + min_ret))),
        "sl_level": F.when(sl > 0, F.col("entry") * (1 - sign * (sl * F.col("sigma") + min_ret))),
    }


def entries(events: DataFrame, bars: DataFrame, vol_span: int = 100, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Numbered bars with volatility, and the events with their entry price and volatility (0.01 if none)."""
    bars = compute(bars, [ew_volatility("volatility", vol_span)], block=block)
    sigma = F.when(F.col("volatility") > 0, F.col("volatility")).otherwise(0.01)
    start = bars.select("ticker", "ts", "pos", F.col("close").alias("entry"), sigma.alias("sigma"))
    return bars, events.join(start, ["ticker", "ts"])


def touch(
    starts: DataFrame,
    bars: DataFrame,
    horizon: int | Column,
    widest: int,
    pt: float | Column,
    sl: float | Column,
    min_ret: float = 0.0,
    side: str | None = None,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """First touch of each event; an event without later bars is dropped, a tie goes to the upper barrier."""
    s = F.col(side) if side else F.lit(1)
    starts = starts.withColumn("_side", F.coalesce(s, F.lit(1)))
    starts = starts.withColumns(_levels(pt, sl, min_ret, F.col("_side")))
    long = F.col("_side") >= 0
    x = F.col("path_close")
    hit_pt = F.when(long, x >= F.col("pt_level")).otherwise(x <= F.col("pt_level"))
    hit_sl = F.when(long, x <= F.col("sl_level")).otherwise(x >= F.col("sl_level"))
    group = ["ticker", *extra_keys, "ts", "pos", "entry", "_side", "pt_level", "sl_level"]
    pairs = future_paths(starts, bars, horizon, widest)
    # Fixed-width buffers keep this a hash aggregate; exits need no second join.
    exits = {"up": F.when(hit_pt, F.col("path_pos")), "down": F.when(hit_sl, F.col("path_pos"))}
    picks = [F.min(at).alias(f"_{n}") for n, at in exits.items()]
    for c in ("path_ts", "path_close"):
        picks += [F.min_by(c, at).alias(f"_{n}_{c}") for n, at in exits.items()]
        picks.append(F.max_by(c, "path_pos").alias(f"_end_{c}"))
    found = pairs.groupBy(*group).agg(*picks)
    upper = F.col("_up").isNotNull() & (F.col("_down").isNull() | (F.col("_up") <= F.col("_down")))
    barrier = F.when(upper, "upper").when(F.col("_down").isNotNull(), "lower").otherwise("vertical")
    exit_of = lambda c: (
        F.when(F.col("barrier") == "upper", F.col(f"_up_{c}"))
        .when(F.col("barrier") == "lower", F.col(f"_down_{c}"))
        .otherwise(F.col(f"_end_{c}"))
    )
    out = found.withColumn("barrier", barrier).withColumns({c: exit_of(c) for c in ("path_ts", "path_close")})
    gain = (F.col("path_close") - F.col("entry")) / F.nullif("entry", F.lit(0.0))
    out = out.withColumn("ret", F.when(long, gain).otherwise(-gain))
    label = (
        F.when(F.col("barrier") == "upper", 1)
        .when(F.col("barrier") == "lower", -1)
        .otherwise(F.when(F.col("ret") > 0, 1).otherwise(-1))
    )
    return out.select(
        "ticker",
        *extra_keys,
        F.col("ts").alias("event_ts"),
        F.col("path_ts").alias("t1"),
        "ret",
        label.alias("label"),
        "barrier",
        "pt_level",
        "sl_level",
    )


def triple_barrier(
    events: DataFrame,
    bars: DataFrame,
    pt: float = 1.0,
    sl: float = 1.0,
    bars_ahead: int = 50,
    min_ret: float = 0.0,
    vol_span: int = 100,
    side: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Labels of ``events(ticker, ts[, side])``: exit time, return, label ±1, barrier and levels."""
    bars, starts = entries(events, bars, vol_span, block)
    return touch(starts, bars, bars_ahead, bars_ahead, pt, sl, min_ret, side)


def with_weights(labels: DataFrame) -> DataFrame:
    """Add ``weight``: |return| over the ticker's mean |return|, between 0.1 and 10; 1 if all are zero."""
    mean = labels.groupBy("ticker").agg(F.avg(F.abs("ret")).alias("_mean"))
    weight = F.when(F.col("_mean") > 0, F.abs("ret") / F.nullif("_mean", F.lit(0.0))).otherwise(1.0)
    return (
        labels.join(mean, "ticker")
        .withColumn("weight", F.least(F.greatest(weight, F.lit(0.1)), F.lit(10.0)))
        .drop("_mean")
    )


def label_summary(labels: DataFrame) -> DataFrame:
    """Counts, mean return and mean |return| by label, by barrier and in total."""
    return (
        labels.groupingSets([["label"], ["barrier"], []], "label", "barrier")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("ret").alias("avg_return"),
            F.avg(F.abs("ret")).alias("avg_abs_return"),
        )
    )
