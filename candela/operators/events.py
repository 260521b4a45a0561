"""Event detection on numbered bars: CUSUM, adaptive CUSUM, Kalman innovations, and their combination."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.operators.timeline import BLOCK, Carry, fold, number

MODES = ("symmetric", "positive", "negative")
WARMUP = 2_000


def _returns(k: Carry, x: np.ndarray) -> np.ndarray:
    """Log returns; missing where either value is missing or not positive."""
    before = k.lag(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.log(x / before)
    return np.where((x > 0) & (before > 0), r, np.nan)


def _rolling_std(k: Carry, x: np.ndarray, n: int, at_least: int, missing: float) -> np.ndarray:
    """Sample deviation of the last n present values, ``missing`` before ``at_least`` of them."""
    here = ~np.isnan(x)
    values = pd.Series(k.tail(x[here], n - 1))
    std = values.rolling(n, min_periods=at_least).std().to_numpy()[n - 1 :]
    out = np.full(len(x), missing)
    out[here] = np.where(np.isnan(std), missing, std)
    return out


def _crossings(k: Carry, returns: np.ndarray, limits: np.ndarray, mode: str) -> np.ndarray:
    """1 where a cumulated sum of returns crosses its limit; the crossing sum (or both) starts again."""
    up, down, both = mode != "negative", mode != "positive", mode == "symmetric"
    high, low = k.take([0.0, 0.0])
    fired = np.zeros(len(returns), dtype="int64")
    for i, (r, limit) in enumerate(zip(returns.tolist(), limits.tolist())):
        if r != r:
            continue
        high, low = max(0.0, high + r), min(0.0, low + r)
        if up and high > limit:
            fired[i], high = 1, 0.0
            low = 0.0 if both else low
        elif down and low < -limit:
            fired[i], low = 1, 0.0
            high = 0.0 if both else high
    k.give(high, low)
    return fired


def _walk(bars: DataFrame, step, outputs, column: str, keys: Sequence[str], block: int, tolerance: float = 0.0) -> DataFrame:
    slim = number(bars, keys).select(*keys, "ts", "pos", column)
    return fold(slim, step, outputs, [column], warmup=WARMUP, tolerance=tolerance, keys=keys, block=block)


def cusum(
    bars: DataFrame, threshold: float, mode: str = "symmetric", keys: Sequence[str] = ("ticker",), block: int = BLOCK
) -> DataFrame:
    """Bars at which the cumulated log return since the last event leaves ±threshold (strictly)."""
    if threshold <= 0:
        raise ValueError(f"CUSUM threshold must be positive, got {threshold}")
    if mode not in MODES:
        raise ValueError(f"CUSUM mode must be one of {MODES}, got {mode!r}")

    def step(k: Carry, x):
        r = _returns(k, x["close"])
        return {"fired": _crossings(k, r, np.full(len(r), float(threshold)), mode)}

    fired = _walk(bars, step, {"fired": "long"}, "close", keys, block)
    return fired.filter("fired = 1").select(*keys, "ts")


def adaptive_cusum_grid(
    bars: DataFrame,
    ks: Sequence[float],
    lookback: int = 100,
    mode: str = "symmetric",
    column: str = "close",
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
) -> DataFrame:
    """Numbered bars with ``fired_0, fired_1, ...``: adaptive CUSUM for every k in one walk.

    The limit is k rolling standard deviations of the returns (0.01 before half a window of returns).
    """
    if mode not in MODES:
        ks = [float("inf")] * len(ks)  # an unknown mode fires nothing
    ks = [float(v) for v in ks]

    def step(state: Carry, x):
        r = _returns(state, x[column])
        sigma = _rolling_std(state, r, lookback, max(1, lookback // 2), 0.01)
        return {f"fired_{i}": _crossings(state, r, v * sigma, mode) for i, v in enumerate(ks)}

    return _walk(bars, step, {f"fired_{i}": "long" for i in range(len(ks))}, column, keys, block)


def adaptive_cusum(
    bars: DataFrame,
    k: float = 0.5,
    lookback: int = 100,
    mode: str = "symmetric",
    column: str = "close",
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
) -> DataFrame:
    """CUSUM events with a limit of k rolling standard deviations."""
    fired = adaptive_cusum_grid(bars, [k], lookback, mode, column, keys, block)
    return fired.filter("fired_0 = 1").select(*keys, "ts")


def kalman_innovations(
    bars: DataFrame,
    process_noise: float = 0.01,
    measurement_noise: float = 1.0,
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
) -> DataFrame:
    """Bars with ``innovation``, the close minus a one-dimensional Kalman level estimated from earlier
    closes, and ``spread``, its rolling deviation (50 bars, at least 10, else 1)."""

    def step(state: Carry, x):
        level, variance = state.take([np.nan, 1.0])
        out = np.full(len(x["close"]), np.nan)
        for i, z in enumerate(x["close"].tolist()):
            if level != level:
                level = z
                continue
            variance += process_noise
            gain = variance / (variance + measurement_noise)
            out[i] = z - level
            level += gain * out[i]
            variance *= 1.0 - gain
        state.give(level, variance)
        return {"innovation": out, "spread": _rolling_std(state, out, 50, 10, 1.0)}

    outputs = {"innovation": "double", "spread": "double"}
    return _walk(bars, step, outputs, "close", keys, block, tolerance=1e-12)


def kalman(
    bars: DataFrame,
    process_noise: float = 0.01,
    measurement_noise: float = 1.0,
    threshold_std: float = 2.0,
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
) -> DataFrame:
    """Bars whose innovation exceeds ``threshold_std`` rolling deviations."""
    rows = kalman_innovations(bars, process_noise, measurement_noise, keys, block)
    return rows.filter(F.abs("innovation") > F.lit(float(threshold_std)) * F.col("spread")).select(*keys, "ts")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def unique_sorted(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["ticker", "ts"]).orderBy("ticker", "ts")


def detect(
    bars: DataFrame,
    method: str = "adaptive_cusum",
    mode: str = "symmetric",
    threshold: float = 0.02,
    k_price: float = 0.5,
    k_volume: float | None = None,
    lookback: int = 100,
    combine: str = "union",
    process_noise: float = 0.01,
    measurement_noise: float = 1.0,
    threshold_std: float = 2.0,
    block: int = BLOCK,
) -> DataFrame:
    """Distinct events ``(ticker, ts)`` by one of the three methods, optionally joined by volume events."""
    if method == "cusum":
        events = cusum(bars, threshold, mode, block=block)
    elif method == "adaptive_cusum":
        events = adaptive_cusum(bars, k_price, lookback, mode, block=block)
    elif method == "kalman":
        events = kalman(bars, process_noise, measurement_noise, threshold_std, block=block)
    else:
        raise ValueError(f"unknown event method {method!r}")
    if k_volume is not None and combine in ("union", "intersection"):
        volume = adaptive_cusum(bars, k_volume, lookback, mode, "volume", block=block)
        events = union(events, volume) if combine == "union" else intersection(events, volume)
    return events.dropDuplicates(["ticker", "ts"])


def event_summary(bars: DataFrame, events: DataFrame, min_events: int = 50) -> DataFrame:
    """Per ticker: events, bars, their ratio, first and last event, and whether there are too few."""
    n = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"))
    e = events.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event")
    )
    found = F.coalesce("n_events", F.lit(0))
    return n.join(e, "ticker", "left").select(
        "ticker",
        found.alias("n_events"),
        "n_bars",
        F.round(found / F.col("n_bars"), 4).alias("event_ratio"),
        "first_event",
        "last_event",
        (found < min_events).alias("too_few"),
    )
