"""Technical indicators, normalisers and timeframes over numbered bars.

An indicator is split into the parts it needs, and ``compute`` runs the same part of all requested
indicators together: short windows, running values, state folds, bounded windows. A hundred
indicators therefore cost as many shuffles as one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.scalars import nonzero, ratio
from candela.operators.timeline import BLOCK, Carry, Frame, bounded, fold, number, running

Stage = Callable[[Frame], dict[str, Column]]


@dataclass
class Indicator:
    outputs: dict[str, Column]
    prep: Stage | None = None  # windows reaching one bar back
    running: dict[str, tuple[str, Column]] = field(default_factory=dict)
    step: Callable[[Carry, dict[str, np.ndarray]], dict[str, np.ndarray]] | None = None
    step_inputs: Sequence[str] = ()
    step_outputs: Sequence[str] = ()
    warmup: int = 0
    stages: Sequence[Stage] = ()
    back: int = 0


@dataclass(frozen=True)
class Cols:
    """Names of the bar columns an indicator reads; timeframe variants use other names."""

    open: str = "open"
    high: str = "high"
    low: str = "low"
    close: str = "close"
    volume: str = "volume"

    @property
    def typical(self) -> Column:
        return (F.col(self.high) + F.col(self.low) + F.col(self.close)) / 3.0


BASE = Cols()


def compute(
    bars: DataFrame,
    indicators: Sequence[Indicator],
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append the outputs of all ``indicators``; helper columns are dropped (``keep`` narrows the rest)."""
    out = number(bars, keys)
    keep = list(out.columns if keep is None else keep)
    preps = [i.prep for i in indicators if i.prep]
    if preps:
        out = bounded(out, [lambda f: _merged(p(f) for p in preps)], back=1, keys=keys, block=block)
    run = _merged(i.running for i in indicators)
    if run:
        out = running(out, run, keys=keys, block=block)
    steps = [i for i in indicators if i.step]
    if steps:
        walks = [i.step for i in steps]
        out = fold(
            out,
            lambda carry, x: _merged([w(carry, x) for w in walks]),
            {n: "double" for i in steps for n in i.step_outputs},
            sorted({c for i in steps for c in i.step_inputs}),
            warmup=max(i.warmup for i in steps),
            tolerance=1e-13,
            keys=keys,
            block=block,
        )
    depth = max((len(i.stages) for i in indicators), default=0)
    if depth:
        levels = [[i.stages[k] for i in indicators if len(i.stages) > k] for k in range(depth)]
        stages = [lambda f, level=level: _merged(s(f) for s in level) for level in levels]
        out = bounded(out, stages, back=max(i.back for i in indicators), keys=keys, block=block)
    return out.select(*keep, *[e.alias(n) for i in indicators for n, e in i.outputs.items()])


def _merged(parts) -> dict:
    return {k: v for part in parts for k, v in part.items()}


def _memory(alpha: float) -> int:
    """Rows after which an exponential weight has fallen below 1e-16."""
    return 1 if alpha >= 1 else int(np.ceil(-37.0 / np.log(1.0 - alpha)))


def _span(n: float) -> float:
    return 2.0 / (n + 1.0)


# ---- bounded windows ---------------------------------------------------------------------------


def willr(name: str, n: int = 14, c: Cols = BASE) -> Indicator:
    def stage(f: Frame):
        return {
            f"_{name}_hh": f.full(F.max(c.high), F.col(c.high), n),
            f"_{name}_ll": f.full(F.min(c.low), F.col(c.low), n),
        }

    top, bottom = F.col(f"_{name}_hh"), F.col(f"_{name}_ll")
    return Indicator({name: ratio(F.lit(-100.0) * (top - F.col(c.close)), top - bottom)}, stages=[stage], back=n - 1)


def cmf(name: str, n: int = 20, c: Cols = BASE) -> Indicator:
    flow = (
        ratio(
            (F.col(c.close) - F.col(c.low)) - (F.col(c.high) - F.col(c.close)), F.col(c.high) - F.col(c.low)
        )
        * F.col(c.volume)
    )

    def stage(f: Frame):
        return {name: f.full(F.sum(flow), flow, n) / nonzero(f.full(F.sum(c.volume), F.col(c.volume), n))}

    return Indicator({name: F.col(name)}, stages=[stage], back=n - 1)


def cci(name: str, n: int = 20, c: Cols = BASE) -> Indicator:
    tp = c.typical

    def stage(f: Frame):
        return {
            f"_{name}_mean": f.full(F.avg(tp), tp, n),
            f"_{name}_list": F.collect_list(tp).over(f.last(n)),
        }

    values = F.col(f"_{name}_list")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - F.col(f"_{name}_mean")))
    deviation = F.try_divide(total, F.size(values))
    return Indicator(
        {name: (tp - F.col(f"_{name}_mean")) / (0.015 * nonzero(deviation))}, stages=[stage], back=n - 1
    )


def bbands(names: Sequence[str], n: int = 20, num_std: float = 2.0, c: Cols = BASE) -> Indicator:
    """Upper band, lower band and middle, in the order of ``names``."""
    upper, lower, middle = names
    x = F.col(c.close)

    def stage(f: Frame):
        return {f"_{middle}_m": f.full(F.avg(x), x, n), f"_{middle}_s": f.full(F.stddev_samp(x), x, n)}

    m, s = F.col(f"_{middle}_m"), F.col(f"_{middle}_s")
    return Indicator({upper: m + num_std * s, lower: m - num_std * s, middle: m}, stages=[stage], back=n - 1)


def trans_rate(name: str, n: int = 20, c: Cols = BASE) -> Indicator:
    def prep(f: Frame):
        return {f"_{name}_d": F.abs(F.col(c.close) - f.lag(c.close))}

    def stage(f: Frame):
        return {name: F.avg(f"_{name}_d").over(f.last(n)) / nonzero(F.avg(c.volume).over(f.last(n)))}

    return Indicator({name: F.col(name)}, prep=prep, stages=[stage], back=n - 1)


def tick_autocorr(name: str, n: int = 20, c: Cols = BASE) -> Indicator:
    """Lag-1 autocorrelation of the last n returns."""
    r, before = f"_{name}_r", f"_{name}_p"

    def first(f: Frame):
        return {r: ratio(c.close, f.lag(c.close)) - 1}

    def second(f: Frame):
        return {before: f.lag(r)}

    def third(f: Frame):
        pairs = f.last(n - 1)
        # A window in which one side does not vary has no correlation.
        varies = (F.max(r).over(pairs) > F.min(r).over(pairs)) & (F.max(before).over(pairs) > F.min(before).over(pairs))
        joint = F.covar_samp(r, before).over(pairs)
        spread = F.stddev_samp(r).over(pairs) * F.stddev_samp(before).over(pairs)
        return {name: F.when((F.count(r).over(f.last(n)) >= n) & varies, F.try_divide(joint, spread))}

    return Indicator({name: F.col(name)}, stages=[first, second, third], back=n + 1)


def mfi(name: str, n: int = 14, c: Cols = BASE) -> Indicator:
    """Money flow index; the first bar has no direction, so its flow is zero but it counts."""
    tp = c.typical

    def prep(f: Frame):
        return {f"_{name}_p": f.lag(tp)}

    up = F.when(tp > F.col(f"_{name}_p"), tp * F.col(c.volume)).otherwise(0.0)
    down = F.when(tp < F.col(f"_{name}_p"), tp * F.col(c.volume)).otherwise(0.0)

    def stage(f: Frame):
        return {f"_{name}_up": f.full(F.sum(up), up, n), f"_{name}_dn": f.full(F.sum(down), down, n)}

    flow = ratio(f"_{name}_up", f"_{name}_dn")
    return Indicator({name: 100.0 - 100.0 / (1.0 + flow)}, prep=prep, stages=[stage], back=n - 1)


def ofi(name: str, n: int = 20, c: Cols = BASE) -> Indicator:
    """Volume of rising bars against volume of falling bars; an unchanged bar keeps the last direction."""

    def prep(f: Frame):
        return {f"_{name}_d": F.signum(F.nullif(F.col(c.close) - f.lag(c.close), F.lit(0.0)))}

    def stage(f: Frame):
        side = F.col(f"_{name}_side")
        v = F.col(c.volume)
        buy = F.sum(F.when(side == 1, v).otherwise(0.0)).over(f.last(n))
        sell = F.sum(F.when(side == -1, v).otherwise(0.0)).over(f.last(n))
        return {f"_{name}_b": buy, f"_{name}_s": sell}

    b, s = F.col(f"_{name}_b"), F.col(f"_{name}_s")
    return Indicator(
        {name: (b - s) / nonzero(b + s)},
        prep=prep,
        running={f"_{name}_side": ("last", F.col(f"_{name}_d"))},
        stages=[stage],
        back=n - 1,
    )


# ---- running values ----------------------------------------------------------------------------


def vwap(name: str, c: Cols = BASE) -> Indicator:
    return Indicator(
        {name: ratio(f"_{name}_pv", f"_{name}_v")},
        running={f"_{name}_pv": ("sum", c.typical * F.col(c.volume)), f"_{name}_v": ("sum", F.col(c.volume))},
    )


def obv(name: str, c: Cols = BASE) -> Indicator:
    def prep(f: Frame):
        return {f"_{name}_d": F.coalesce(F.signum(F.col(c.close) - f.lag(c.close)), F.lit(0.0))}

    return Indicator(
        {name: F.col(f"_{name}_o")},
        prep=prep,
        running={f"_{name}_o": ("sum", F.col(c.volume) * F.col(f"_{name}_d"))},
    )


# ---- exponential weights and ratchets ----------------------------------------------------------


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / np.where(b == 0, np.nan, b)


def _true_range(carry: Carry, high, low, close) -> np.ndarray:
    before = carry.lag(close)
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


def ema(name: str, n: int, source: str = "close") -> Indicator:
    return Indicator(
        {name: F.col(name)},
        step=lambda k, x: {name: k.ewm(x[source], _span(n), n)},
        step_inputs=[source],
        step_outputs=[name],
        warmup=_memory(_span(n)),
    )


def ema_std(name: str, n: int, source: str = "close", at_least: int | None = None) -> Indicator:
    need = n if at_least is None else at_least
    return Indicator(
        {name: F.col(name)},
        step=lambda k, x: {name: k.ewm(x[source], _span(n), need, std=True)},
        step_inputs=[source],
        step_outputs=[name],
        warmup=_memory(_span(n)),
    )


def ems_pct(name: str, n: int = 20, c: Cols = BASE) -> Indicator:
    mean = ema(f"_{name}_e", n, c.close)
    mean.outputs = {name: ratio(F.col(c.close) - F.col(f"_{name}_e"), f"_{name}_e") * 100.0}
    return mean


def ema_norm(name: str, source: str, n: int = 100) -> Indicator:
    mean = ema(f"_{name}_e", n, source)
    mean.outputs = {name: ratio(F.col(source) - F.col(f"_{name}_e"), f"_{name}_e")}
    return mean


def ew_volatility(name: str, n: int = 100, c: Cols = BASE) -> Indicator:
    """Exponentially weighted std of log returns, from half a span on."""

    def step(k: Carry, x):
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.log(x[c.close] / k.lag(x[c.close]))
        return {name: k.ewm(np.where(np.isfinite(r), r, np.nan), _span(n), max(1, n // 2), std=True)}

    return Indicator(
        {name: F.col(name)}, step=step, step_inputs=[c.close], step_outputs=[name], warmup=_memory(_span(n)) + 1
    )


def rsi(name: str, n: int = 14, c: Cols = BASE) -> Indicator:
    def step(k: Carry, x):
        change = x[c.close] - k.lag(x[c.close])
        gain = k.ewm(np.where(np.isnan(change), np.nan, np.maximum(change, 0.0)), 1.0 / n, n)
        loss = k.ewm(np.where(np.isnan(change), np.nan, np.maximum(-change, 0.0)), 1.0 / n, n)
        return {name: 100.0 - 100.0 / (1.0 + _divide(gain, loss))}

    return Indicator(
        {name: F.col(name)}, step=step, step_inputs=[c.close], step_outputs=[name], warmup=_memory(1.0 / n) + 1
    )


def macd(names: Sequence[str], fast: int = 12, slow: int = 26, signal: int = 9, c: Cols = BASE) -> Indicator:
    """Line, signal and histogram, in the order of ``names``."""

    def step(k: Carry, x):
        line = k.ewm(x[c.close], _span(fast), fast) - k.ewm(x[c.close], _span(slow), slow)
        mean = k.ewm(line, _span(signal), signal)
        return dict(zip(names, (line, mean, line - mean)))

    return Indicator(
        {n: F.col(n) for n in names},
        step=step,
        step_inputs=[c.close],
        step_outputs=list(names),
        warmup=_memory(_span(slow)) + _memory(_span(signal)),
    )


def atr(name: str, n: int = 14, c: Cols = BASE) -> Indicator:
    def step(k: Carry, x):
        return {name: k.ewm(_true_range(k, x[c.high], x[c.low], x[c.close]), 1.0 / n, n)}

    return Indicator(
        {name: F.col(name)},
        step=step,
        step_inputs=[c.high, c.low, c.close],
        step_outputs=[name],
        warmup=_memory(1.0 / n) + 1,
    )


def adx(name: str, n: int = 14, c: Cols = BASE) -> Indicator:
    def step(k: Carry, x):
        high, low = x[c.high], x[c.low]
        tr = _true_range(k, high, low, x[c.close])
        up, down = high - k.lag(high), k.lag(low) - low
        rise = np.where((up > down) & (up > 0), up, 0.0)
        drop = np.where((down > up) & (down > 0), down, 0.0)
        wilder = lambda v: k.ewm(v, 1.0 / n, n)
        mean_range = wilder(tr)
        plus, minus = 100.0 * _divide(wilder(rise), mean_range), 100.0 * _divide(wilder(drop), mean_range)
        return {name: wilder(100.0 * _divide(np.abs(plus - minus), plus + minus))}

    return Indicator(
        {name: F.col(name)},
        step=step,
        step_inputs=[c.high, c.low, c.close],
        step_outputs=[name],
        warmup=2 * _memory(1.0 / n) + 1,
    )


def supertrend(name: str, n: int = 10, multiplier: float = 3.0, c: Cols = BASE) -> Indicator:
    """Trailing band around the range midpoint: a band only tightens while its side holds."""

    def step(k: Carry, x):
        high, low, close = x[c.high], x[c.low], x[c.close]
        width = multiplier * k.ewm(_true_range(k, high, low, close), 1.0 / n, n)
        middle = (high + low) / 2.0
        upper, lower = middle + width, middle - width
        side, ceiling, floor, seen = k.take([1.0, np.nan, np.nan, 0.0])
        line = np.full(len(close), np.nan)
        for i in range(len(close)):
            top, bottom = upper[i], lower[i]
            if seen:
                if close[i] > ceiling:
                    side = 1.0
                elif close[i] < floor:
                    side = -1.0
                elif side > 0:
                    bottom = floor if bottom < floor else bottom
                else:
                    top = ceiling if top > ceiling else top
                line[i] = bottom if side > 0 else top
            ceiling, floor, seen = top, bottom, 1.0
        k.give(side, ceiling, floor, seen)
        return {name: line}

    return Indicator(
        {name: F.col(name)},
        step=step,
        step_inputs=[c.high, c.low, c.close],
        step_outputs=[name],
        warmup=_memory(1.0 / n) + 200,
    )


# ---- normalisers and smoothers -----------------------------------------------------------------


def _half(n: int) -> int:
    return max(1, n // 2)


def quantile_rank(name: str, source: str, n: int = 100) -> Indicator:
    """Percentile rank of the present value among the last n (average rank on ties)."""
    x = F.col(source)

    def stage(f: Frame):
        return {f"_{name}_l": F.collect_list(x).over(f.last(n))}

    values = F.col(f"_{name}_l")
    total = F.size(values)
    less = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    rank = F.try_divide(less + (equal + 1) / 2.0, total)
    return Indicator({name: F.when((total >= _half(n)) & x.isNotNull(), rank)}, stages=[stage], back=n - 1)


def zscore(name: str, source: str, n: int = 100) -> Indicator:
    x = F.col(source)

    def stage(f: Frame):
        mean, std = f.full(F.avg(x), x, n, _half(n)), f.full(F.stddev_samp(x), x, n, _half(n))
        return {name: (x - mean) / nonzero(std)}

    return Indicator({name: F.col(name)}, stages=[stage], back=n - 1)


def mean_subtraction(name: str, source: str, n: int = 100) -> Indicator:
    x = F.col(source)
    return Indicator({name: F.col(name)}, stages=[lambda f: {name: x - f.full(F.avg(x), x, n, _half(n))}], back=n - 1)


def mean_division(name: str, source: str, n: int = 100) -> Indicator:
    x = F.col(source)
    return Indicator(
        {name: F.col(name)}, stages=[lambda f: {name: x / nonzero(f.full(F.avg(x), x, n, _half(n)))}], back=n - 1
    )


def smooth(name: str, source: str, n: int, method: str = "ema") -> Indicator:
    x = F.col(source)
    if method == "ema":
        return ema(name, n, source)
    if method == "sma":
        return Indicator({name: F.col(name)}, stages=[lambda f: {name: f.full(F.avg(x), x, n)}], back=n - 1)
    if method == "wma":

        def stage(f: Frame):
            total = sum((f.lag(x, i) * float(n - i) for i in range(1, n)), x * float(n))
            return {name: total / (n * (n + 1) / 2.0)}

        return Indicator({name: F.col(name)}, stages=[stage], back=n - 1)
    return Indicator({name: x})


NORMALISERS: dict[str, Callable[[str, str, int], Indicator]] = {
    "quantiles": quantile_rank,
    "zscore": zscore,
    "ema_norm": ema_norm,
    "mean_sub": mean_subtraction,
    "mean_div": mean_division,
}


def normalise(df: DataFrame, columns: Sequence[str], methods: Sequence[str], n: int = 100, block: int = BLOCK) -> DataFrame:
    """Every method over every column, appended as ``{column}__{method}``.

    A sliding Spark frame recomputes its n rows for each output row and aggregate; over a wide feature
    table that dominates the run time. Here all columns of a block are normalised in one pass over Arrow
    batches, with the last n - 1 values as the state handed from block to block.
    """
    methods = [m for m in methods if m in NORMALISERS]
    columns = list(columns)
    if not methods:
        return df
    need = _half(n)

    def step(k: Carry, x):
        out = {}
        for c in columns:
            values = pd.Series(k.tail(x[c], n - 1))
            here = values.iloc[n - 1 :]
            frame = values.rolling(n, min_periods=need)
            mean = frame.mean().iloc[n - 1 :]
            made = {"mean_sub": lambda: here - mean, "mean_div": lambda: _divide(here.to_numpy(), mean.to_numpy())}
            made["zscore"] = lambda: _divide((here - mean).to_numpy(), frame.std().iloc[n - 1 :].to_numpy())
            made["quantiles"] = lambda: frame.rank(pct=True).iloc[n - 1 :]
            for m in methods:
                if m == "ema_norm":
                    level = k.ewm(x[c], _span(n), n)
                    out[f"{c}__{m}"] = _divide(x[c] - level, level)
                else:
                    out[f"{c}__{m}"] = np.asarray(made[m](), dtype=float)
        return out

    names = [f"{c}__{m}" for m in methods for c in columns]
    warmup = max(n - 1, _memory(_span(n)) if "ema_norm" in methods else 0)
    out = fold(
        number(df), step, {m: "double" for m in names}, columns, warmup=warmup, tolerance=1e-13, block=block
    )
    return out


# ---- returns -----------------------------------------------------------------------------------


def returns(prefix: str, bars: int = 1, close: str = "close") -> Indicator:
    """Simple return, log return and realised volatility over ``bars`` base bars."""
    window = max(2, 20 * bars)
    r, lr, vol = f"{prefix}_return", f"{prefix}_log_return", f"{prefix}_realized_vol"

    def first(f: Frame):
        change = ratio(close, f.lag(close, bars))
        return {r: change - 1, lr: F.ln(change)}

    def second(f: Frame):
        return {vol: f.full(F.stddev_samp(r), F.col(r), window, max(1, window // 2))}

    return Indicator({n: F.col(n) for n in (r, lr, vol)}, stages=[first, second], back=window + bars)


def rolling(name: str, n: int, value: Callable[[Column], Column], source: str = "close") -> Indicator:
    """Any function of the array of the last n values (missing until n values exist)."""
    x = F.col(source)

    def stage(f: Frame):
        return {f"_{name}_l": F.collect_list(x).over(f.last(n))}

    values = F.col(f"_{name}_l")
    return Indicator({name: F.when(F.size(values) == n, value(values))}, stages=[stage], back=n - 1)


# ---- timeframes --------------------------------------------------------------------------------

HOLD_AGG = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}


def _over_bin(agg: str, x: Column, w) -> Column:
    ordered = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if agg == "first":
        return F.first(x, ignorenulls=True).over(ordered)
    if agg == "last":
        return F.last(x, ignorenulls=True).over(ordered)
    plain = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}[agg]
    return plain(x).over(w)


def hold(
    bars: DataFrame,
    base_minutes: int,
    minutes: int,
    columns: dict[str, tuple[str, str]],
    mode: str = "closed",
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
) -> DataFrame:
    """Values of a coarser timeframe for each bar: ``columns`` maps output to (source, aggregate).

    Bins start at midnight of the first day of a series. ``mode="hold"`` gives a bar the final value of
    its own bin, which looks ahead inside the bin; ``mode="closed"`` gives the last bin that has ended.
    """
    bars = number(bars, keys)
    if minutes <= base_minutes:
        return bars.withColumns({n: F.col(src) for n, (src, _) in columns.items()})
    keys = list(keys)
    start = bars.groupBy(*keys).agg(F.date_trunc("day", F.min("ts")).alias("_day0"))
    width = minutes * 60
    binned = bars.join(start, keys).withColumn(
        "_bin", F.floor((F.unix_seconds("ts") - F.unix_seconds("_day0")) / F.lit(width))
    )
    if mode == "hold":
        w = Window.partitionBy(*keys, "_bin")
        return binned.withColumns({n: _over_bin(agg, F.col(src), w) for n, (src, agg) in columns.items()}).drop(
            "_bin", "_day0"
        )
    # Last bar of a bin carries the bin's value; the next bins see it by filling forward.
    w = Window.partitionBy(*keys, "_bin")
    last = F.col("pos") == F.max("pos").over(w)
    marked = binned.withColumns(
        {f"_v_{n}": F.when(last, _over_bin(agg, F.col(src), w)) for n, (src, agg) in columns.items()}
    )
    shifted = bounded(
        marked, [lambda f: {f"_w_{n}": f.lag(f"_v_{n}") for n in columns}], back=1, keys=keys, block=block
    )
    filled = running(shifted, {n: ("last", F.col(f"_w_{n}")) for n in columns}, keys=keys, block=block)
    return filled.drop("_bin", "_day0", *[f"_{p}_{n}" for n in columns for p in "vw"])
