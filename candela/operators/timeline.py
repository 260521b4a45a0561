"""Ordered work on long series without putting one series into one task.

A ticker may hold a third of all rows, so no window or grouped map here is partitioned by ticker alone:

* ``number`` gives every bar its 1-based position in its series (two-level count by time slice);
* ``halo`` cuts the numbered series into equal blocks and copies the few rows a bounded frame needs
  from the neighbouring block;
* ``running`` computes unbounded running values as local running value plus the carry of earlier blocks;
* ``fold`` runs an order-dependent step per block and verifies the hand-over of state between blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.session import checkpointed

BLOCK = 65_536
MINUTE = 60
DAY = 86_400


def number(
    df: DataFrame,
    keys: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("ts",),
    step: int = MINUTE,
    name: str = "pos",
    block: int = BLOCK,
) -> DataFrame:
    """Add the 1-based position of each row in its series; a no-op when the column is already there.

    ``order[0]`` must be a timestamp. ``step`` is the least usual distance of rows in seconds: a slice of
    ``step * block`` seconds then holds at most about ``block`` rows, and only one counter per slice
    crosses slices. The default suits minute to daily bars; give the real step for finer ones.
    """
    if name in df.columns:
        return df
    keys = list(keys)
    sliced = df.withColumn("_slice", F.floor(F.unix_micros(order[0]) / F.lit(step * block * 1_000_000)))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .join(offsets, keys + ["_slice"])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_slice", "_local", "_before")
    )


def halo(
    df: DataFrame, back: int = 0, ahead: int = 0, block: int = BLOCK, pos: str = "pos"
) -> DataFrame:
    """Assign rows to blocks (``blk``) and copy border rows to the neighbour (``own`` is false on copies).

    Every own row then has its ``back`` predecessors and ``ahead`` successors in the same block.
    """
    block = max(block, back, ahead, 1)
    index = F.floor((F.col(pos) - 1) / F.lit(block)).cast("long")
    offset = (F.col(pos) - 1) % F.lit(block)
    if not back and not ahead:
        return df.withColumn("blk", index).withColumn("own", F.lit(True))
    targets = [index]
    if back:
        targets.append(F.when(offset >= block - back, index + 1))
    if ahead:
        targets.append(F.when((offset < ahead) & (index > 0), index - 1))
    return (
        df.withColumn("_home", index)
        .withColumn("blk", F.explode(F.array_compact(F.array(*targets))))
        .withColumn("own", F.col("blk") == F.col("_home"))
        .drop("_home")
    )


class Frame:
    """Window specs inside one block; all share one partitioning and order, so one sort serves them."""

    def __init__(self, keys: Sequence[str] = ("ticker",), pos: str = "pos"):
        self.ordered = Window.partitionBy(*keys, "blk").orderBy(pos)

    def last(self, n: int):
        return self.ordered.rowsBetween(-(n - 1), 0)

    def next(self, n: int):
        return self.ordered.rowsBetween(1, n)

    def lag(self, column: Column | str, n: int = 1) -> Column:
        return F.lag(column, n).over(self.ordered)

    def lead(self, column: Column | str, n: int = 1) -> Column:
        return F.lead(column, n).over(self.ordered)

    def full(self, value: Column, counted: Column, n: int, at_least: int | None = None) -> Column:
        """``value`` over the last n rows, missing until ``at_least`` non-null ``counted`` values exist."""
        need = n if at_least is None else at_least
        return F.when(F.count(counted).over(self.last(n)) >= need, value.over(self.last(n)))


def bounded(
    df: DataFrame,
    stages: Sequence[Callable[[Frame], dict[str, Column]]],
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
    drop: Sequence[str] = (),
    pos: str = "pos",
) -> DataFrame:
    """Add window columns whose frames reach at most ``back`` rows back and ``ahead`` rows forward.

    ``stages`` run one after another; a later stage may use columns of an earlier one, and ``back`` is
    the total reach. All windows share one shuffle on (keys, block).
    """
    frame = Frame(keys, pos)
    out = halo(df, back, ahead, block, pos)
    for stage in stages:
        out = out.withColumns(stage(frame))
    if back or ahead:
        out = out.filter("own")
    return out.drop("blk", "own", *drop)


RUNNING = {
    # kind: (aggregate, combine carry with local value)
    "sum": (F.sum, lambda carry, local: F.when(
        carry.isNotNull() | local.isNotNull(), F.coalesce(carry, F.lit(0.0)) + F.coalesce(local, F.lit(0.0)))),
    "max": (F.max, lambda carry, local: F.greatest(carry, local)),
    "min": (F.min, lambda carry, local: F.least(carry, local)),
    "product": (F.product, lambda carry, local: F.when(
        carry.isNotNull() | local.isNotNull(), F.coalesce(carry, F.lit(1.0)) * F.coalesce(local, F.lit(1.0)))),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carry, local: F.coalesce(local, carry)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda carry, local: F.coalesce(carry, local)),
}


def running(
    df: DataFrame,
    columns: dict[str, tuple[str, Column]],
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
    backward: bool = False,
    pos: str = "pos",
) -> DataFrame:
    """Add running values ``{name: (kind, expression)}`` over the whole series up to and including each row.

    ``kind`` is a key of RUNNING. ``backward`` runs from the end ("last" then means the next non-null).
    Each block contributes one summary row; carries are running values over those summaries only.
    """
    keys = list(keys)
    sign = F.desc if backward else F.asc
    local = Window.partitionBy(*keys, "blk").orderBy(sign(pos))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    staged = halo(df, block=block, pos=pos).drop("own")
    staged = staged.withColumns({f"_x_{n}": expr for n, (_, expr) in columns.items()})
    staged = staged.withColumns({f"_l_{n}": RUNNING[k][0](F.col(f"_x_{n}")).over(upto) for n, (k, _) in columns.items()})
    # The value at the block's last row (in running order) is the block's summary.
    edge = F.min_by if backward else F.max_by
    summary = staged.groupBy(*keys, "blk").agg(
        *[edge(f"_l_{n}", pos).alias(f"_s_{n}") for n in columns]
    )
    earlier = Window.partitionBy(*keys).orderBy(sign("blk")).rowsBetween(Window.unboundedPreceding, -1)
    carries = summary.select(
        *keys, "blk", *[RUNNING[k][0](F.col(f"_s_{n}")).over(earlier).alias(f"_c_{n}") for n, (k, _) in columns.items()]
    )
    out = staged.join(carries, keys + ["blk"])
    out = out.withColumns({n: RUNNING[k][1](F.col(f"_c_{n}"), F.col(f"_l_{n}")) for n, (k, _) in columns.items()})
    return out.drop("blk", *[f"_{p}_{n}" for p in "xlc" for n in columns])


class Carry:
    """State handed from row block to row block while a step function walks over column arrays.

    A step function calls the methods below in a fixed order; each call consumes its slots of the
    incoming state and appends the slots of the outgoing state.
    """

    def __init__(self, state: Sequence[float] | None):
        self._in = None if state is None else list(state)
        self._at = 0
        self.out: list[float] = []

    def take(self, fresh: Sequence[float]) -> list[float]:
        if self._in is None:
            return list(fresh)
        got = self._in[self._at : self._at + len(fresh)]
        self._at += len(fresh)
        return got

    def give(self, *values: float) -> None:
        self.out.extend(float(v) for v in values)

    def lag(self, x: np.ndarray) -> np.ndarray:
        (before,) = self.take([np.nan])
        self.give(x[-1] if len(x) else before)
        return np.concatenate([[before], x[:-1]]) if len(x) else x

    def tail(self, x: np.ndarray, n: int) -> np.ndarray:
        """``x`` with the n values before it in front (missing before the series starts)."""
        joined = np.concatenate([self.take([np.nan] * n), x])
        self.give(*joined[len(joined) - n :])
        return joined

    def ewm(self, x: np.ndarray, alpha: float, at_least: int, std: bool = False) -> np.ndarray:
        """Exponentially weighted mean (or sample std) with weights (1-alpha)^age over all earlier rows.

        Missing values age the weights but add nothing; the result repeats across them and is missing
        before ``at_least`` values were seen.
        """
        weight, mean, spread, square, seen = self.take([0.0, 0.0, 0.0, 0.0, 0.0])
        q = 1.0 - alpha
        out = np.full(len(x), np.nan)
        # Stretches short enough that q**-stretch stays far from overflow; q = 0 keeps only the last value.
        stretch = max(1, int(230.0 / -np.log(q))) if q > 0 else 1
        for lo in range(0, len(x), stretch):
            part = x[lo : lo + stretch]
            here = ~np.isnan(part)
            centre = mean if seen > 0 else (part[here][0] if here.any() else 0.0)
            d = np.where(here, part - centre, 0.0)
            fade = q ** np.arange(1, len(part) + 1, dtype=float)
            # Weight of a row relative to the row it is seen from is fade[row] * rise[age].
            rise = np.where(here, 1.0 / fade if q > 0 else 1.0, 0.0)
            scale = fade if q > 0 else np.ones(len(part))
            w = fade * weight + scale * np.cumsum(rise)
            s1 = scale * np.cumsum(d * rise)
            s2 = fade * spread + scale * np.cumsum(d * d * rise)
            w2 = fade * fade * square + scale * scale * np.cumsum(rise * rise)
            values_seen = seen + np.cumsum(here)
            with np.errstate(divide="ignore", invalid="ignore"):
                mu = np.where(w > 0, centre + s1 / w, centre)
                m2 = np.where(w > 0, np.maximum(s2 - s1 * s1 / w, 0.0), 0.0)
                value = np.sqrt(m2 / w * (w * w / (w * w - w2))) if std else mu
            need = max(at_least, 2 if std else 1)
            out[lo : lo + len(part)] = np.where(values_seen >= need, value, np.nan)
            weight, mean, spread, square, seen = w[-1], mu[-1], m2[-1], w2[-1], values_seen[-1]
        self.give(weight, mean, spread, square, seen)
        return out


Step = Callable[[Carry, dict[str, np.ndarray]], dict[str, np.ndarray]]


def fold(
    df: DataFrame,
    step: Step,
    outputs: dict[str, str],
    inputs: Sequence[str],
    warmup: int = 0,
    tolerance: float = 0.0,
    keys: Sequence[str] = ("ticker",),
    block: int = BLOCK,
    pos: str = "pos",
) -> DataFrame:
    """Run an order-dependent ``step`` over each numbered series, block by block, and append its outputs.

    All blocks run at the same time. A block that does not know the state its predecessor leaves guesses
    it by walking over the ``warmup`` rows in front of it. Afterwards every guess is compared with the
    state the predecessor really left (equal, or within ``tolerance`` relative); blocks with a wrong
    guess run again from the real state until all agree. The result is therefore that of one walk over
    the whole series, while memory per task stays at one block.
    """
    keys = list(keys)
    if not inputs or warmup < 0:
        raise ValueError("a fold needs input columns and a warm-up of at least 0 rows")
    carried = [c for c in df.columns]
    hints = {f.name: f.dataType for f in df.schema.fields}
    out_fields = [T.StructField(c, hints[c]) for c in carried]
    out_fields += [T.StructField(n, T.DoubleType() if t == "double" else T.LongType()) for n, t in outputs.items()]
    state = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        out_fields + [T.StructField("blk", T.LongType()), T.StructField("_in", state), T.StructField("_out", state)]
    )
    inputs = list(inputs)

    def arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        return {c: pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs}

    def walk(own: pd.DataFrame, start: list[float] | None) -> pd.DataFrame:
        carry = Carry(start)
        values = step(carry, arrays(own))
        result = own[carried].copy()
        for name in outputs:
            result[name] = values[name]
            if outputs[name] == "long":
                result[name] = result[name].astype("int64")
        result["blk"] = own["blk"]
        result["_in"] = None
        result["_out"] = None
        last = result.index[-1]
        result.at[last, "_in"] = start
        result.at[last, "_out"] = carry.out
        return result[schema.fieldNames()]

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        own = pdf[pdf["own"]].reset_index(drop=True)
        if own.empty:
            return pd.DataFrame()
        start = None
        ahead = pdf[~pdf["own"]]
        if len(ahead):
            carry = Carry(None)
            step(carry, arrays(ahead))
            start = carry.out
        return walk(own, start)

    def repeat(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable").reset_index(drop=True)
        return walk(pdf, list(pdf["_start"].iloc[0]))

    group = keys + ["blk"]
    blocks = halo(df, back=min(warmup, block), block=block, pos=pos)
    done = checkpointed(blocks.groupBy(*group).applyInPandas(guess, schema))
    for repair in count(1):
        ends = done.filter("_out is not null").select(*group, "_in", "_out")
        left = ends.select(*keys, (F.col("blk") + 1).alias("blk"), F.col("_out").alias("_start"))
        wrong = ends.join(left, group).filter(~_agree("_in", "_start", tolerance)).select(*group, "_start")
        wrong = checkpointed(wrong)
        if wrong.isEmpty():
            return done.drop("blk", "_in", "_out")
        # Only repaired blocks are written again; reading leaves out what they replace.
        again = done.select(*carried, "blk").join(wrong, group).groupBy(*group).applyInPandas(repeat, schema)
        done = done.join(wrong, group, "left_anti").unionByName(checkpointed(again))
        if repair % 8 == 0:
            done = checkpointed(done)


def _agree(a: str, b: str, tolerance: float) -> Column:
    same = F.col(a).eqNullSafe(F.col(b))
    if not tolerance:
        return same
    close = F.forall(
        F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")),
        lambda p: p["x"].eqNullSafe(p["y"])
        | (F.abs(p["x"] - p["y"]) <= tolerance * F.greatest(F.abs(p["x"]), F.abs(p["y"]))),
    )
    return F.coalesce(same | close, F.lit(False))
