"""The feature table: indicators on timeframes, returns, smoothing, normalising and column choice."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.scalars import finite, timeframe_minutes
from candela.operators import indicators as ind
from candela.operators.timeline import BLOCK, number
from candela.session import checkpointed


@dataclass(frozen=True)
class Entry:
    build: Callable[..., ind.Indicator]
    inputs: tuple[str, ...]
    names: tuple[str, ...]
    params: dict[str, list]


# Indicator names, output names and default parameters.
REGISTRY: dict[str, Entry] = {
    "rsi": Entry(ind.rsi, ("close",), ("rsi_{period}",), {"period": [14]}),
    "macd": Entry(
        ind.macd, ("close",), ("macd_line", "macd_signal", "macd_hist"), {"fast": [12], "slow": [26], "signal": [9]}
    ),
    "cci": Entry(ind.cci, ("high", "low", "close"), ("cci_{period}",), {"period": [20]}),
    "willr": Entry(ind.willr, ("high", "low", "close"), ("willr_{period}",), {"period": [14]}),
    "bbands": Entry(
        ind.bbands,
        ("close",),
        ("bb_upper_{period}", "bb_lower_{period}", "bb_middle_{period}"),
        {"period": [20], "num_std": [2.0]},
    ),
    "adx": Entry(ind.adx, ("high", "low", "close"), ("adx_{period}",), {"period": [14]}),
    "atr": Entry(ind.atr, ("high", "low", "close"), ("atr_{period}",), {"period": [14]}),
    "supertrend": Entry(
        ind.supertrend, ("high", "low", "close"), ("supertrend_{period}",), {"period": [10], "multiplier": [3.0]}
    ),
    "vwap": Entry(ind.vwap, ("high", "low", "close", "volume"), ("vwap",), {}),
    "cmf": Entry(ind.cmf, ("high", "low", "close", "volume"), ("cmf_{period}",), {"period": [20]}),
    "mfi": Entry(ind.mfi, ("high", "low", "close", "volume"), ("mfi_{period}",), {"period": [14]}),
    "obv": Entry(ind.obv, ("close", "volume"), ("obv",), {}),
    "ofi": Entry(ind.ofi, ("open", "high", "low", "close", "volume"), ("ofi_{period}",), {"period": [20]}),
    "trans_rate": Entry(ind.trans_rate, ("close", "volume"), ("trans_rate_{period}",), {"period": [20]}),
    "tick_autocorr": Entry(ind.tick_autocorr, ("close",), ("tick_autocorr_{period}",), {"period": [20]}),
    "ems_pct": Entry(ind.ems_pct, ("close",), ("ems_pct_{span}",), {"span": [20]}),
}


def choices(params: dict[str, list]) -> list[dict]:
    """All combinations of the value lists, first name varying slowest."""
    names = list(params)
    lists = [v if isinstance(v, list) else [v] for v in params.values()]
    return [dict(zip(names, values)) for values in product(*lists)]


def _output_names(entry: Entry, tf: str, combo: dict) -> list[str]:
    """Names carry every parameter that differs from its default, so a grid never repeats a name."""
    shown = {p for n in entry.names for p in entry.params if "{" + p + "}" in n}
    extra = "".join(
        f"_{p}{combo[p]:g}" for p, default in entry.params.items() if p not in shown and combo[p] not in default
    )
    return [f"{tf}_{n.format(**combo)}{extra}" for n in entry.names]


def plan_indicators(
    names: Sequence[str], timeframes: Sequence[str], base_minutes: int, params: dict[str, dict]
) -> tuple[list[ind.Indicator], list[str]]:
    """Indicators and their output names for all timeframes not finer than the bars."""
    built: list[ind.Indicator] = []
    outputs: list[str] = []
    for name in names:
        entry = REGISTRY.get(name)
        if entry is None:
            continue
        given = {p: params.get(name, {}).get(p, default) for p, default in entry.params.items()}
        for tf in timeframes:
            if timeframe_minutes(tf) < base_minutes:
                continue
            source = columns_of(tf, base_minutes)
            for combo in choices(given):
                out = _output_names(entry, tf, combo)
                target = out if len(out) > 1 else out[0]
                built.append(entry.build(target, *combo.values(), c=source))
                outputs += out
    return built, outputs


def columns_of(tf: str, base_minutes: int) -> ind.Cols:
    if timeframe_minutes(tf) <= base_minutes:
        return ind.BASE
    return ind.Cols(*[f"{c}@{tf}" for c in ("open", "high", "low", "close", "volume")])


def build_features(
    bars: DataFrame,
    base_minutes: int,
    timeframes: Sequence[str],
    indicators: Sequence[str] = (),
    params: dict[str, dict] | None = None,
    smooth: dict | None = None,
    normalize: dict | None = None,
    subset: dict | None = None,
    mode: str = "closed",
    block: int = BLOCK,
) -> DataFrame:
    """``ticker, ts, pos`` and one column per feature.

    Each bar column is brought to a timeframe once and shared by all indicators of that timeframe.
    """
    out = checkpointed(number(bars))
    valid = [tf for tf in timeframes if timeframe_minutes(tf) >= base_minutes]
    names = list(indicators) or list(REGISTRY)
    needed = {c for n in names if n in REGISTRY for c in REGISTRY[n].inputs} | {"close"}
    for tf in valid:
        if timeframe_minutes(tf) > base_minutes:
            wanted = {f"{c}@{tf}": (c, ind.HOLD_AGG[c]) for c in sorted(needed)}
            out = ind.hold(out, base_minutes, timeframe_minutes(tf), wanted, mode, block=block)
    if any(timeframe_minutes(tf) > base_minutes for tf in valid):
        # Read several times below; filling bins forward is a chain of shuffles worth doing once.
        out = checkpointed(out)
    built, features = plan_indicators(names, valid, base_minutes, params or {})
    for tf in valid:
        span = max(1, timeframe_minutes(tf) // base_minutes)
        built.append(ind.returns(tf, span, columns_of(tf, base_minutes).close))
        features += [f"{tf}_return", f"{tf}_log_return", f"{tf}_realized_vol"]
    keys = ["ticker", "ts", "pos"]
    out = ind.compute(out, built, block=block, keep=keys)
    if smooth:
        method, window = smooth.get("method", "ema"), smooth.get("window", 5)
        extra = [ind.smooth(f"{c}__smooth_{method}{window}", c, window, method) for c in features]
        out = ind.compute(out, extra, block=block)
        features = out.columns[len(keys):]
    if normalize:
        out = ind.normalise(out, features, normalize.get("methods", []), normalize.get("window", 100), block)
        features = out.columns[len(keys):]
    if subset:
        features = choose_names(features, subset.get("include", ()), subset.get("exclude", ()))
        out = out.select(*keys, *features)
        if subset.get("max_features"):
            out = fullest(out, features, subset["max_features"])
            features = out.columns[len(keys):]
    return out.select(*keys, *[finite(c).alias(c) for c in features])


def choose_names(names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Keep names matching any ``include`` pattern (all, if none matches) and no ``exclude`` pattern."""
    kept = [n for n in names if any(re.search(p, n) for p in include)] if include else list(names)
    kept = kept or list(names)
    return [n for n in kept if not any(re.search(p, n) for p in exclude)]


def missing_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, missing_share`` in one pass over the data."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns])
    return shares.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_share")) for c in columns])
        ).alias("s")
    ).select("s.*")


def _shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    # One row per column of the table: its size is the schema's, not the data's.
    return {r["column"]: r["missing_share"] or 0.0 for r in missing_share(df, columns).collect()}


def fullest(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Keep the n columns with the least missing share (earlier columns win ties)."""
    if len(columns) <= n:
        return df
    shares = _shares(df, columns)
    best = sorted(columns, key=lambda c: shares[c])[:n]
    return df.select(*[c for c in df.columns if c not in columns], *best)


def drop_sparse(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Drop columns whose missing share is above ``threshold``."""
    shares = _shares(df, columns)
    return df.drop(*[c for c in columns if shares[c] > threshold])


def with_parameters(df: DataFrame, params: dict[str, list]) -> DataFrame:
    """Every row once per parameter combination; the grid is a literal in the plan, not a joined table."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in combo.items()]) for combo in choices(params)]
    return df.withColumn("_p", F.explode(F.array(*cells))).select(*df.columns, "_p.*")
