"""Stored intermediate results and models."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_hash(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def inventory(bars: DataFrame) -> DataFrame:
    """What a stored result depends on: rows and last bar of each series."""
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"), F.max("ts").alias("last_ts"))


def save_stage(root: str, config: dict, bars: DataFrame, features: DataFrame, events: DataFrame) -> str:
    """Write features and events under a folder named by the configuration; returns the folder."""
    folder = f"{root.rstrip('/')}/config={config_hash(config)}"
    features.write.mode("overwrite").partitionBy("ticker").parquet(f"{folder}/features")
    events.write.mode("overwrite").partitionBy("ticker").parquet(f"{folder}/events")
    # Written last: a folder without inventory is not complete.
    inventory(bars).write.mode("overwrite").parquet(f"{folder}/inventory")
    return folder


def load_stage(spark: SparkSession, root: str, config: dict, bars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored features and events of series that have not changed, and the tickers to compute anew."""
    folder = f"{root.rstrip('/')}/config={config_hash(config)}"
    stored = spark.read.parquet(f"{folder}/inventory")
    now = inventory(bars)
    fresh = now.join(stored, ["ticker", "n_bars", "last_ts"], "left_semi").select("ticker")
    stale = now.join(fresh, "ticker", "left_anti").select("ticker")
    parts = [spark.read.parquet(f"{folder}/{p}").join(fresh, "ticker", "left_semi") for p in ("features", "events")]
    return parts[0], parts[1], stale


def save_model(
    spark: SparkSession, path: str, model: PipelineModel, features: list[str], metrics: dict[str, float], cutoff: datetime
) -> None:
    """A fitted model with the facts needed to use it: features, metrics and training cutoff."""
    model.write().overwrite().save(f"{path}/model")
    row = [(features, {k: float(v) for k, v in metrics.items()}, cutoff)]
    schema = "features array<string>, metrics map<string,double>, cutoff timestamp"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def load_model(
    spark: SparkSession, path: str, cutoff: datetime
) -> tuple[PipelineModel, list[str], dict[str, float]] | None:
    """The stored model, or None when there is none or it was trained for another cutoff."""
    facts_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/facts/_SUCCESS")
    if not facts_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(facts_path):
        return None
    facts = spark.read.parquet(f"{path}/facts").first()
    if facts["cutoff"] != cutoff:
        return None
    return PipelineModel.load(f"{path}/model"), list(facts["features"]), dict(facts["metrics"])
