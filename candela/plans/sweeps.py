"""Parameter sweeps for event detection and labels, and the chain of both."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.operators import events, labels
from candela.operators.timeline import BLOCK, number
from candela.session import checkpointed

# The values tried when none are given.
DEFAULT_KS = (0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)
DEFAULT_PAIRS = ((0.5, 0.5), (1.0, 1.0), (1.5, 1.0), (1.0, 1.5), (2.0, 1.0), (1.0, 2.0))
DEFAULT_HORIZONS = (25, 50, 100)


def event_grid(
    bars: DataFrame, ks: Sequence[float] = DEFAULT_KS, lookback: int = 100, mode: str = "symmetric", block: int = BLOCK
) -> DataFrame:
    """Bars with an array ``fired`` that has one flag per k; one walk over the bars for all k."""
    grid = events.adaptive_cusum_grid(bars, ks, lookback, mode, block=block)
    return grid.select("ticker", "ts", "pos", F.array(*[F.col(f"fired_{i}") for i in range(len(ks))]).alias("fired"))


def event_ratios(grid: DataFrame, ks: Sequence[float] = DEFAULT_KS) -> DataFrame:
    """``ticker, rank, k, n_events, share, ratio``: events per bar for every k (``ratio`` is rounded)."""
    counts = grid.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_bars"), *[F.sum(F.col("fired")[i]).alias(f"_n{i}") for i in range(len(ks))]
    )
    cells = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(float(k)).alias("k"), F.col(f"_n{i}").alias("n_events")) for i, k in enumerate(ks)])
    rows = counts.select("ticker", "_bars", F.explode(cells).alias("_c")).select("ticker", "_bars", "_c.*")
    share = F.col("n_events") / F.col("_bars")
    return rows.select("ticker", "rank", "k", "n_events", share.alias("share"), F.round(share, 4).alias("ratio"))


def best_k(ratios: DataFrame, low: float = 0.01, high: float = 0.10) -> DataFrame:
    """The k per ticker whose event share is in range and nearest to the range's geometric mean.

    If none is in range, the nearest of all by rounded ratio; the first wins ties.
    """
    middle = math.sqrt(low * high)
    inside = F.col("share").between(low, high)
    near = F.when(inside, F.abs(F.col("share") - middle)).otherwise(F.abs(F.col("ratio") - middle))
    order = F.struct((~inside).cast("int"), near, F.col("rank"))
    pick = F.min_by(F.struct("rank", "k", "ratio"), order).alias("_b")
    return ratios.groupBy("ticker").agg(pick).select("ticker", "_b.rank", F.col("_b.k").alias("best_k"), F.col("_b.ratio").alias("best_ratio"))


def barrier_balances(
    found: DataFrame,
    bars: DataFrame,
    pairs: Sequence[Sequence[float]] = DEFAULT_PAIRS,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    min_ret: float = 0.0,
    vol_span: int = 100,
    block: int = BLOCK,
) -> DataFrame:
    """Labels and +1 labels for every barrier pair and horizon.

    Each event meets its longest path once. For a level only the first bar beyond it matters, and for a
    horizon only the last bar inside it, so all combinations follow from a few aggregates per event.
    """
    bars, starts = labels.entries(found, bars, vol_span, block)
    widest = max(horizons)
    path = labels.future_paths(starts, bars, widest, widest)
    ups, downs = sorted({float(p) for p, _ in pairs}), sorted({float(s) for _, s in pairs})
    x, at = F.col("path_close"), F.col("path_pos") - F.col("pos")
    upper = lambda m: F.min(F.when(x >= F.col("entry") * (1 + (m * F.col("sigma") + min_ret)), at))
    lower = lambda m: F.min(F.when(x <= F.col("entry") * (1 - (m * F.col("sigma") + min_ret)), at))
    nothing = F.lit(None).cast("long")
    seen = path.groupBy("ticker", "pos", "entry", "sigma").agg(
        *[(upper(m) if m > 0 else F.min(nothing)).alias(f"_u{i}") for i, m in enumerate(ups)],
        *[(lower(m) if m > 0 else F.min(nothing)).alias(f"_d{i}") for i, m in enumerate(downs)],
        *[F.max_by(F.when(at <= h, x), F.when(at <= h, at)).alias(f"_e{i}") for i, h in enumerate(horizons)],
    )
    cells = []
    for a, (pt, sl) in enumerate(pairs):
        for b, h in enumerate(horizons):
            up = F.col(f"_u{ups.index(float(pt))}")
            down = F.col(f"_d{downs.index(float(sl))}")
            up, down = F.when(up <= h, up), F.when(down <= h, down)
            ends_up = F.col(f"_e{b}") > F.col("entry")
            positive = F.when(up.isNotNull() & (down.isNull() | (up <= down)), True).when(down.isNotNull(), False).otherwise(ends_up)
            cells.append(
                F.struct(
                    F.lit(a * len(horizons) + b).alias("rank"), F.lit(float(pt)).alias("pt"), F.lit(float(sl)).alias("sl"),
                    F.lit(int(h)).alias("bars_ahead"), positive.alias("_positive"),
                )
            )
    each = seen.select("ticker", F.explode(F.array(*cells)).alias("_c")).select("ticker", "_c.*")
    return each.groupBy("ticker", "rank", "pt", "sl", "bars_ahead").agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if("_positive").alias("n_positive")
    ).withColumn("share", F.col("n_positive") / F.col("n_labels")).withColumn("balance", F.round("share", 4))


def best_barriers(balances: DataFrame, target: float = 0.5) -> DataFrame:
    """The combination per ticker whose share of +1 labels is nearest to ``target``; the first wins ties."""
    order = F.struct(F.abs(F.col("share") - target), F.col("rank"))
    pick = F.min_by(F.struct("pt", "sl", "bars_ahead", "balance"), order).alias("_b")
    return balances.groupBy("ticker").agg(pick).select("ticker", "_b.*")


def auto_labels(
    bars: DataFrame,
    ks: Sequence[float] = DEFAULT_KS,
    pairs: Sequence[Sequence[float]] = DEFAULT_PAIRS,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    lookback: int = 100,
    min_ret: float = 0.0,
    vol_span: int = 100,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Labels made with the best k and the best barriers of each ticker, and those choices."""
    bars = checkpointed(number(bars))
    grid = event_grid(bars, ks, lookback, block=block)
    chosen = checkpointed(best_k(event_ratios(grid, ks)))
    found = grid.join(chosen.select("ticker", "rank"), "ticker").filter(F.get("fired", F.col("rank")) == 1).select("ticker", "ts")
    found = checkpointed(found)
    settings = chosen.drop("rank").join(best_barriers(barrier_balances(found, bars, pairs, horizons, min_ret, vol_span, block)), "ticker")
    settings = checkpointed(settings)
    bars, starts = labels.entries(found, bars, vol_span, block)
    starts = starts.join(settings.select("ticker", "pt", "sl", "bars_ahead"), "ticker")
    out = labels.touch(starts, bars, F.col("bars_ahead"), max(horizons), F.col("pt"), F.col("sl"), min_ret)
    return labels.with_weights(out), settings
