"""Samples (features joined to labels) and purged walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.operators.timeline import number


def align(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the bars that carry a label."""
    return features.join(labels.withColumnRenamed("event_ts", "ts"), ["ticker", "ts"])


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every feature is present."""
    return df.dropna("any", subset=list(columns))


def restrict(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Label rows whose event survives among the samples."""
    kept = samples.select("ticker", F.col("ts").alias("event_ts"))
    return labels.join(kept, ["ticker", "event_ts"], "left_semi")


def walk_forward(
    samples: DataFrame,
    n_splits: int = 5,
    test_size: float = 0.2,
    min_train: int = 100,
    purge: timedelta | None = None,
    width: int | None = None,
) -> DataFrame:
    """``ticker, ts, fold, role``: test blocks from the end of each series, training rows before them.

    A training row is kept when its label ended (``t1``) before the test starts; without ``t1`` it must
    lie ``purge`` before it. Folds with too few training rows are left out. ``width`` limits training to
    the last rows before the test. Rows right after a test block never train here, so no embargo is needed.
    """
    samples = number(samples.select("ticker", "ts", *[c for c in samples.columns if c in ("t1", "pos_sample")]), name="row")
    sizes = samples.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    folds = (
        sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .withColumn("test_n", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(test_size))))
        .withColumn("test_from", F.col("n") - (F.lit(n_splits - 1) - F.col("fold") + 1) * F.col("test_n"))
        .filter(F.col("test_from") >= min_train)
        .withColumn("test_until", F.col("test_from") + F.col("test_n"))
    )
    # The test start time of each fold is one row of the samples (0-based row test_from).
    starts = samples.select("ticker", (F.col("row") - 1).alias("test_from"), F.col("ts").alias("test_start"))
    folds = folds.join(starts, ["ticker", "test_from"]).drop("n", "test_n")
    rows = samples.join(folds, "ticker")
    at = F.col("row") - 1
    is_test = (at >= F.col("test_from")) & (at < F.col("test_until"))
    before = F.col("ts") < F.col("test_start")
    if "t1" in samples.columns:
        train = before & (F.col("t1").isNull() | (F.col("t1") < F.col("test_start")))
    else:
        gap = purge or timedelta(hours=24)
        train = F.col("ts") < F.col("test_start") - F.expr(f"INTERVAL {int(gap.total_seconds())} SECONDS")
    if width:
        train = train & (at >= F.col("test_from") - width)
    roles = rows.withColumn("role", F.when(is_test, "test").when(train, "train")).filter(F.col("role").isNotNull())
    enough = (
        roles.filter("role = 'train'").groupBy("ticker", "fold").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_train)
    )
    return roles.join(enough, ["ticker", "fold"], "left_semi").select("ticker", "ts", "fold", "role")


def fold_summary(folds: DataFrame) -> DataFrame:
    """Rows and time bounds of each fold and role."""
    return folds.groupBy("ticker", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("starts"), F.max("ts").alias("ends")
    )


def purged_train_end(train_end: Column, test_start: Column, barrier_hours: int) -> Column:
    """Training must stop a label's length before the test starts."""
    return F.least(train_end, test_start - F.expr(f"INTERVAL {barrier_hours} HOURS"))


def embargo_end(test_end: Column, total_micros: Column, share: float) -> Column:
    """End of the quiet time after a test: ``share`` of the whole span."""
    return F.timestamp_micros(F.unix_micros(test_end) + F.round(total_micros * F.lit(share)).cast("long"))
