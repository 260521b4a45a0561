"""Evaluation of fold predictions ``(ticker, ts, fold, close, y_prob, y_true)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.operators import metrics

FOLD = ["ticker", "fold"]
SCORES = ("auc", "accuracy", "precision", "recall", "f1", "sharpe")


def evaluate_folds(predictions: DataFrame, commission_bps: float = 1.0, risk_free: float = 0.0, periods: int = 252) -> DataFrame:
    """One row of metrics per ticker and fold."""
    traded = metrics.strategy_returns(predictions, commission_bps)
    net = metrics.sharpe(traded, FOLD, "strategy_return_net", risk_free, periods)
    gross = metrics.sharpe(traded, FOLD, "strategy_return", risk_free, periods).withColumnRenamed("sharpe", "sharpe_gross")
    out = metrics.auc(predictions, FOLD)
    for part in (metrics.classification(predictions, FOLD), net, gross):
        out = out.join(part, FOLD)
    return out


def report(
    predictions: DataFrame, commission_bps: float = 1.0, risk_free: float = 0.0, periods: int = 252, trials: int = 10,
    partitions: int = 8,
) -> DataFrame:
    """One row per ticker: means over folds, total growth of the joined folds, deflated Sharpe ratio, and the probability of overfitting
    with the folds' net returns as strategies."""
    folds = evaluate_folds(predictions, commission_bps, risk_free, periods)
    per_fold = F.sort_array(F.collect_list(F.struct("fold", *SCORES, "sharpe_gross")))
    means = folds.groupBy("ticker").agg(
        *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in SCORES],
        F.round(F.stddev_samp("auc"), 4).alias("std_auc"),
        F.round(F.stddev_samp("sharpe"), 4).alias("std_sharpe"),
        per_fold.alias("per_fold"),
    )
    net = metrics.strategy_returns(predictions, commission_bps).select("ticker", "ts", F.col("strategy_return_net").alias("ret"))
    growth = metrics.growth(metrics.equity(net, ["ticker"]), ["ticker"], periods)
    growth = growth.select(
        "ticker", *[F.round(c, 4).alias(c) for c in ("total_return", "max_drawdown")], F.round("calmar_final", 4).alias("calmar_ratio")
    )
    out = means.join(growth, "ticker").join(metrics.moments(net, ["ticker"]), "ticker")
    out = metrics.deflated_sharpe(out.withColumn("sharpe", F.col("mean_sharpe")), trials)
    strategies = metrics.strategy_returns(predictions, commission_bps).select(
        "ticker", F.col("fold").cast("string").alias("strategy"), "ts", F.col("strategy_return_net").alias("ret")
    )
    risk = metrics.overfitting_probability(strategies, partitions, keys=["ticker"])
    out = out.join(risk.select("ticker", F.round("pbo", 4).alias("pbo"), F.col("n_combinations").alias("pbo_n_combinations")), "ticker")
    return out.withColumn("dsr", F.round("dsr", 4)).withColumn("dsr_trials", F.lit(trials)).drop("sharpe")
