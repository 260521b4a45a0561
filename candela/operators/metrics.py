"""Classification and strategy metrics as grouped aggregates.

Return series are tables ``(group columns, ts, ret)``; value series are ``(group columns, ts, value)``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.operators.timeline import BLOCK, bounded, number, running

SLICES, PARTS = 64, 1_024
EULER_GAMMA = 0.5772156649  # fixed value


# ---- classification ----------------------------------------------------------------------------


def auc(df: DataFrame, keys: Sequence[str], score: str = "y_prob", truth: str = "y_true") -> DataFrame:
    """Area under the ROC curve per group by rank sums, ties counting half; 0.5 when a class is absent.

    Equal scores are counted first. The distinct scores of a group are then cut into slices at
    approximate quantiles, and only one count per slice crosses slices, so one group may be of any size.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(F.col(truth) == 1).alias("_p"), F.count_if(F.col(truth) != 1).alias("_n")
    )
    at = [i / SLICES for i in range(1, SLICES)]
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx("_s", at, F.lit(1_000)).alias("_cuts"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi")
    )
    # Between two quantiles a slice is cut further at equal distances.
    at_cut = F.size(F.filter("_cuts", lambda q: q < F.col("_s")))
    edges = F.concat(F.array("_lo"), F.col("_cuts"), F.array("_hi"))
    left, right = F.get(edges, F.col("_cut")), F.get(edges, F.col("_cut") + 1)
    part = F.floor(F.coalesce(F.try_divide(F.col("_s") - left, right - left), F.lit(0.0)) * PARTS)
    sliced = (
        counts.join(cuts, keys)
        .withColumn("_cut", at_cut)
        .withColumn("_slice", F.col("_cut") * (PARTS + 1) + part)
        .drop("_cuts", "_lo", "_hi", "_cut")
    )
    before_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_carry", F.coalesce(F.sum("_m").over(before_slice), F.lit(0)))
        .drop("_m")
    )
    below = Window.partitionBy(*keys, "_slice").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).join(carry, keys + ["_slice"])
    won = F.sum(F.col("_p") * (F.col("_below") + F.col("_carry") + F.col("_n") / 2.0))
    pairs = F.sum("_p").cast("double") * F.sum("_n")
    return ranked.groupBy(*keys).agg(F.coalesce(F.try_divide(won, pairs), F.lit(0.5)).alias("auc"))


def classification(df: DataFrame, keys: Sequence[str], score: str = "y_prob", truth: str = "y_true", cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 at ``score > cut``; a ratio without cases is 0."""
    guess, real = F.col(score) > cut, F.col(truth) == 1
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.count_if(guess & real), F.count_if(guess & ~real), F.count_if(~guess & real)
    return df.groupBy(*keys).agg(
        share(F.count_if(guess == real), F.count(F.lit(1))).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


# ---- strategies --------------------------------------------------------------------------------


def strategy_returns(
    predictions: DataFrame, commission_bps: float = 1.0, keys: Sequence[str] = ("ticker",), fold: str = "fold", block: int = BLOCK
) -> DataFrame:
    """Add position (±1 by ``y_prob > 0.5``), gross and net return of the previous position in each fold."""

    def stage(f):
        side = F.when(F.col("y_prob") > 0.5, 1).otherwise(-1)
        same = f.lag(fold) == F.col(fold)
        change = F.when(same, F.try_divide(F.col("close"), f.lag("close")) - 1)
        traded = F.when(same, F.abs(side - f.lag(side)))
        return {
            "position": side,
            "strategy_return": F.coalesce(F.when(same, f.lag(side)) * change, F.lit(0.0)),
            "cost": F.coalesce(traded * (commission_bps / 10_000.0), F.lit(0.0)),
        }

    out = bounded(number(predictions, keys), [stage], back=1, keys=keys, block=block)
    return out.withColumn("strategy_return_net", F.col("strategy_return") - F.col("cost")).drop("cost")


def simple_returns(values: DataFrame, keys: Sequence[str], value: str = "close", first: float | None = None, block: int = BLOCK) -> DataFrame:
    """``ret``, the change against the row before; the first row is dropped, or gets ``first``."""
    rows = number(values, keys)
    out = bounded(rows, [lambda f: {"ret": F.try_divide(F.col(value), f.lag(value)) - 1}], back=1, keys=keys, block=block)
    if first is None:
        return out.filter(F.col("ret").isNotNull())
    return out.withColumn("ret", F.coalesce("ret", F.lit(first)))


def equity(returns: DataFrame, keys: Sequence[str], ret: str = "ret", block: int = BLOCK) -> DataFrame:
    """Add ``equity``, the running product of 1 + return."""
    return running(number(returns, keys), {"equity": ("product", 1 + F.col(ret))}, keys, block)


def max_drawdown(values: DataFrame, keys: Sequence[str], value: str = "equity", start_at: float | None = None, block: int = BLOCK) -> DataFrame:
    """Deepest fall from the running peak, as a negative share."""
    peaks = running(number(values, keys), {"_peak": ("max", F.col(value))}, keys, block)
    return peaks.groupBy(*keys).agg(F.min(F.try_divide(F.col(value) - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"))


def _sharpe(x: Column, std, periods: float) -> Column:
    return F.coalesce(F.try_divide(F.sqrt(F.lit(float(periods))) * F.avg(x), std(x)), F.lit(0.0))


def sharpe(returns: DataFrame, keys: Sequence[str], ret: str = "ret", risk_free: float = 0.0, periods: int = 252, population: bool = False) -> DataFrame:
    """Annualised Sharpe ratio; 0 when returns do not vary."""
    x = F.col(ret) - risk_free / periods
    return returns.groupBy(*keys).agg(_sharpe(x, F.stddev_pop if population else F.stddev_samp, periods).alias("sharpe"))


def sortino(returns: DataFrame, keys: Sequence[str], ret: str = "ret", target: float = 0.0, periods: int = 252) -> DataFrame:
    """Mean excess over the deviation of the negative excess returns alone."""
    x = F.col(ret) - target / periods
    down = F.stddev_samp(F.when(x < 0, x))
    value = F.try_divide(F.avg(x), down) * F.sqrt(F.lit(float(periods)))
    return returns.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("sortino"))


def information_ratio(returns: DataFrame, keys: Sequence[str], ret: str = "ret", benchmark: str = "benchmark", periods: int = 252) -> DataFrame:
    """Sharpe ratio of the difference to a benchmark on the same rows."""
    x = F.col(ret) - F.col(benchmark)
    return returns.groupBy(*keys).agg(_sharpe(x, F.stddev_samp, periods).alias("information_ratio"))


def growth(equities: DataFrame, keys: Sequence[str], periods: int = 252, block: int = BLOCK) -> DataFrame:
    """Total return, CAGR from the first equity point, and both Calmar ratios (by CAGR, by final equity)."""
    rows = number(equities, keys)
    falls = max_drawdown(rows, keys, block=block)
    ends = rows.groupBy(*keys).agg(
        F.min_by("equity", "pos").alias("_first"), F.max_by("equity", "pos").alias("_last"), F.count(F.lit(1)).alias("n")
    )
    power = F.lit(float(periods)) / F.col("n")
    cagr = F.when(
        (F.col("_first") > 0) & (F.col("_last") > 0), F.pow(F.try_divide("_last", "_first"), power) - 1
    ).otherwise(0.0)
    depth = F.abs("max_drawdown")
    return ends.join(falls, list(keys)).select(
        *keys,
        (F.col("_last") - 1).alias("total_return"),
        "max_drawdown",
        cagr.alias("cagr"),
        F.when(depth < 1e-10, 0.0).otherwise(F.try_divide(cagr, depth)).alias("calmar"),
        F.when(depth == 0, 0.0).otherwise(F.try_divide(F.pow("_last", power) - 1, depth)).alias("calmar_final"),
    )


def moments(returns: DataFrame, keys: Sequence[str], ret: str = "ret") -> DataFrame:
    """Count, and bias-corrected skewness and kurtosis (3 for a normal distribution)."""
    n, g, k = F.count(ret).cast("double"), F.skewness(ret), F.kurtosis(ret)
    skew = F.try_divide(g * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * k + 6) + 3
    return returns.groupBy(*keys).agg(
        F.count(ret).alias("n"),
        F.when(n > 2, skew).otherwise(0.0).alias("skew"),
        F.when(n > 3, kurt).otherwise(3.0).alias("kurtosis"),
    )


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; used on one row per strategy."""

    def cdf(values: pd.Series) -> pd.Series:
        return values.map(lambda v: 0.5 * (1.0 + math.erf(v / math.sqrt(2.0))))

    return F.pandas_udf(cdf, T.DoubleType())(z)


def deflated_sharpe(table: DataFrame, trials: int, benchmark: float = 0.0) -> DataFrame:
    """Add ``dsr`` to rows with sharpe, n, skew and kurtosis: the probability that the Sharpe ratio beats
    the best of so many random trials."""
    s = F.col("sharpe")
    luck = benchmark
    if trials > 1:
        spread = math.sqrt(2.0 * math.log(trials))
        luck += spread * (1.0 - EULER_GAMMA / spread)
    variance = F.try_divide(1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4.0 * s * s, F.col("n") - 1)
    z = F.when(variance > 0, F.try_divide(s - luck, F.sqrt(variance)))
    usable = (F.col("n") > 0) & z.isNotNull() & F.lit(trials > 0)
    return table.withColumn("dsr", F.when(usable, normal_cdf(F.coalesce(z, F.lit(0.0)))).otherwise(0.0))


# ---- overfitting -------------------------------------------------------------------------------


def overfitting_probability(
    returns: DataFrame, partitions: int = 8, sample: int | None = None, keys: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Share of in-sample choices of time blocks whose best strategy ranks below the middle out of sample.

    ``returns(keys, strategy, ts, ret)`` should share one clock in each group; times that lack a strategy are left out, and so are the
    times after the last of equally long blocks. With fewer times than ``partitions`` each time is a block. All choices of half of the
    blocks are tried (``sample`` draws so many of them, the same ones on every run). Among equal in-sample scores the first name is
    best. Fewer than two strategies or two blocks give probability 0 with 0 combinations.
    """
    rows = returns.withColumn("_whole", F.lit(1))
    keys = [*keys, "_whole"]
    wanted = rows.groupBy(*keys).agg(F.count_distinct("strategy").alias("_k"))
    common = rows.filter(F.col("ret").isNotNull()).groupBy(*keys, "ts").agg(F.count_distinct("strategy").alias("_c"))
    clock = common.join(wanted, keys).filter((F.col("_c") == F.col("_k")) & (F.col("_k") >= 2)).select(*keys, "ts")
    clock = number(clock, keys, block=block)
    clock = clock.join(clock.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(partitions)))
    p = F.least(F.lit(partitions), F.col("_n")).cast("int")
    blocks = clock.select(*keys, "ts", F.floor((F.col("pos") - 1) / size).cast("int").alias("part"), p.alias("_p"))
    blocks = blocks.filter((F.col("part") < F.col("_p")) & (F.col("_p") >= 2))
    scores = rows.join(blocks, [*keys, "ts"]).groupBy(*keys, "strategy", "part", "_p").agg(
        F.coalesce(F.try_divide(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("score")
    )
    # A choice is a bit mask over the blocks; the masks are set by the number of blocks alone.
    masks = {n: [m for m in range(2**n) if m.bit_count() == n // 2] for n in range(2, partitions + 1)}
    if sample is not None:
        masks = {n: sorted(random.Random(42).sample(m, sample)) if len(m) > sample else m for n, m in masks.items()}
    combos = F.create_map(*[x for n, m in masks.items() for x in (F.lit(n), F.lit(m))])
    chosen = F.expr("shiftright(combo, part) & 1") == 1
    sides = scores.withColumn("combo", F.explode(F.element_at(combos, F.col("_p")))).groupBy(*keys, "combo", "strategy").agg(
        F.avg(F.when(chosen, F.col("score"))).alias("inside"), F.avg(F.when(~chosen, F.col("score"))).alias("outside")
    )
    best = sides.groupBy(*keys, "combo").agg(
        F.min_by("outside", F.struct(-F.col("inside"), F.col("strategy"))).alias("_best"), F.count(F.lit(1)).alias("_k")
    )
    # Average rank of the chosen strategy from the top.
    ranks = sides.join(best, [*keys, "combo"]).groupBy(*keys, "combo", "_k").agg(
        (F.count_if(F.col("outside") > F.col("_best")) + (F.count_if(F.col("outside") == F.col("_best")) + 1) / 2.0).alias("rank")
    )
    found = ranks.groupBy(*keys).agg(
        F.avg((F.col("rank") > F.col("_k") / 2.0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_combinations")
    )
    out = wanted.join(found, keys, "left")
    out = out.select(*keys, F.coalesce("pbo", F.lit(0.0)).alias("pbo"), F.coalesce("n_combinations", F.lit(0)).alias("n_combinations"))
    return out.drop("_whole")


# ---- co-movement -------------------------------------------------------------------------------


def complete_times(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the times at which every ticker of the group has a return."""
    rows = returns.withColumn("_whole", F.lit(1))
    keys = [*keys, "_whole"]
    known = rows.filter(F.col("ret").isNotNull())
    width = rows.groupBy(*keys).agg(F.count_distinct("ticker").alias("_k"))
    full = known.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_c")).join(width, keys).filter(F.col("_c") == F.col("_k"))
    return known.join(full.select(*keys, "ts"), [*keys, "ts"], "left_semi").drop("_whole")


def pair_moments(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Covariance and correlation of every ordered pair of tickers, and the number of ``rows``, over the times that have every ticker.

    One aggregate per pair with map-side combine; rows meet on ``ts``, so a pair is never one task's.
    """
    keys = list(keys)
    rows = complete_times(returns, keys)
    a = rows.select(*keys, "ts", F.col("ticker").alias("a"), F.col("ret").alias("_x"))
    b = rows.select(*keys, "ts", F.col("ticker").alias("b"), F.col("ret").alias("_y"))
    cov = F.covar_samp("_x", "_y")
    half = a.join(b, keys + ["ts"]).filter("a <= b").groupBy(*keys, "a", "b").agg(
        cov.alias("cov"),
        F.try_divide(cov, F.stddev_samp("_x") * F.stddev_samp("_y")).alias("corr"),
        F.count(F.lit(1)).alias("rows"),
    )
    return mirrored(half, keys)


def mirrored(half: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both orders of each pair, from the pairs with a <= b."""
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    values = ["cov", "corr", "rows"]
    return half.select(*keys, F.explode(ways).alias("_w"), *values).select(*keys, "_w.a", "_w.b", *values)


def mean_correlation(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean correlation over unordered pairs."""
    return pairs.filter(F.col("a") < F.col("b")).groupBy(*keys).agg(F.avg("corr").alias("mean_corr"))


def win_loss_columns(x: Column) -> list[Column]:
    """Share of rising rows, mean gain and mean loss (0.01 where there is none)."""
    return [
        F.avg((x > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.01)).alias("avg_gain"),
        F.coalesce(F.abs(F.avg(F.when(x < 0, x))), F.lit(0.01)).alias("avg_loss"),
    ]


def win_loss(returns: DataFrame, keys: Sequence[str], ret: str = "ret") -> DataFrame:
    return returns.groupBy(*keys).agg(*win_loss_columns(F.col(ret)))
