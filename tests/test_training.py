"""Grids in Spark's terms, the fit of one ticker from samples to model, and rows that must not vanish."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import panel, splits
from candela.plans import training
from candela.sources import store


CUT = pd.Timestamp("2024-01-05").to_pydatetime()


@pytest.fixture(scope="module")
def samples(spark):
    chance = random.Random(3)
    rows = []
    for k in range(160):
        x, noise = chance.gauss(0, 1), chance.gauss(0, 1)
        ts = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=k)
        rows.append(("t0", ts.to_pydatetime(), (ts + pd.Timedelta(hours=2)).to_pydatetime(), x, noise, 1 if x + 0.3 * chance.gauss(0, 1) > 0 else -1))
    return spark.createDataFrame(rows, "ticker string, ts timestamp, t1 timestamp, good double, noise double, label int")


def test_combinations_in_sparks_terms():
    form = training.spark_form
    assert form("random_forest", {"max_depth": None})["depth"] == 30
    assert form("lightgbm", {"max_depth": -1, "num_leaves": 63})["depth"] == 6
    assert form("random_forest", {"min_samples_split": 10, "min_samples_leaf": 2})["rows"] == 5
    assert form("catboost", {"depth": 4, "l2_leaf_reg": 1}) == form("catboost", {"depth": 4, "l2_leaf_reg": 5})
    for name, params in (("random_forest", {"max_depth": 31}), ("other", {})):
        with pytest.raises(ValueError):
            form(name, params)
    assert len(training.sampled_grid(training.GRIDS["xgboost"])) == 3 * 3 * 3 * 2 * 2 * 3
    assert len(training.sampled_grid(training.GRIDS["xgboost"], 20)) == 20


def test_training_one_ticker(spark, samples, tmp_path):
    folds = splits.walk_forward(samples.select("ticker", "ts", "t1"), 2, 0.2, 30)
    grid = {"n_estimators": [3], "max_depth": [2, 3], "min_samples_split": [2, 3]}
    model, chosen, results, scored = training.train(samples, folds, ["noise", "good"], "t0", "random_forest", grid)
    assert chosen[0] == "good"
    found = results.collect()
    assert sorted(r["rank"] for r in found) == [0, 1, 2, 3]
    assert {(json.loads(r["params"])["max_depth"], json.loads(r["params"])["min_samples_split"]) for r in found} == {(2, 2), (2, 3), (3, 2), (3, 3)}
    assert training.mean_auc(scored).first()["score"] > 0.8
    signals = training.score(model, samples)
    assert signals.count() == samples.count()
    assert signals.filter("abs(prob_up + prob_down - 1) > 1e-9 OR signal NOT IN (-1, 1)").count() == 0
    store.save_model(spark, str(tmp_path / "m"), model, chosen, {}, CUT)
    again, names, _ = store.load_model(spark, str(tmp_path / "m"), CUT)
    assert names == chosen and training.score(again, samples).exceptAll(signals).count() == 0


def test_missing_features_are_an_error(samples):
    holes = training.prepared(samples.withColumn("good", F.when(F.col("noise") > 0, F.col("good"))))
    with pytest.raises(Exception, match="(?i)null"):
        training.fit(holes, ["good"], "random_forest", {"n_estimators": 2})


def test_every_name_meets_every_row(spark, monkeypatch):
    monkeypatch.setattr(panel, "CHUNK", 3)
    names = spark.createDataFrame([(f"t{k % 10}",) for k in range(25)] + [(None,)], "ticker string")
    got = panel.with_each(spark.range(4), names)
    assert sorted((r["id"], r["ticker"]) for r in got.collect()) == [(i, f"t{k}") for i in range(4) for k in range(10)]
