"""Classifiers over labelled samples: grids, fold fits, feature selection, final fit and scoring.

``samples(ticker, ts, <features>, label ±1[, weight])`` and ``folds(ticker, ts, fold, role)``. Fits run in
Spark; a few run side by side from driver threads.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from math import ceil, log2
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.operators import metrics
from candela.operators.cleaning import fill
from candela.operators.timeline import BLOCK
from candela.plans.features import choices
from candela.session import checkpointed

# Default search grids by model name.
GRIDS: dict[str, dict[str, list]] = {
    "xgboost": {
        "n_estimators": [100, 200, 300], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1],
        "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "min_child_weight": [1, 3, 5],
    },
    "lightgbm": {
        "n_estimators": [100, 200, 300], "max_depth": [3, 5, 7, -1], "learning_rate": [0.01, 0.05, 0.1],
        "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "num_leaves": [31, 63, 127],
    },
    "catboost": {"iterations": [100, 200, 300], "depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1], "l2_leaf_reg": [1, 3, 5]},
    "random_forest": {
        "n_estimators": [100, 200, 300], "max_depth": [3, 5, 7, None], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2"],
    },
}
BOOSTERS = ("xgboost", "lightgbm", "catboost")
DEEPEST = 30  # Spark's own limit of a tree's depth


def spark_form(name: str, params: dict, deepest: int = DEEPEST) -> dict:
    """What a combination means to Spark's trees: parameters that have no twin there leave it unchanged, so that combinations with the
    same form need one fit. No depth limit becomes ``deepest``; a greater depth than Spark's is an error.

    A split of at least n rows leaves halves of n / 2 on average, and l leaves need a depth of log2(l): these stand for
    ``min_samples_split``, and for ``num_leaves`` where the depth is open.
    """
    if name not in ("random_forest", *BOOSTERS):
        raise ValueError(f"model must be random_forest or one of {BOOSTERS}, got {name!r}")
    depth = params.get("max_depth", params.get("depth", 5))
    if depth is None or depth < 0:
        depth = ceil(log2(params["num_leaves"])) if params.get("num_leaves") else deepest
    if depth > DEEPEST:
        raise ValueError(f"Spark's trees are at most {DEEPEST} deep, got {depth}")
    form = {"trees": int(params.get("n_estimators", params.get("iterations", 100))), "depth": int(depth)}
    if name == "random_forest":
        half = ceil(int(params.get("min_samples_split", 2)) / 2)
        return form | {
            "rows": max(int(params.get("min_samples_leaf", 1)), half), "features": str(params.get("max_features", "sqrt"))
        }
    share = params.get("colsample_bytree", 1.0)
    return form | {
        "rows": int(params.get("min_child_weight", 1)), "features": str(share) if share < 1 else "all",
        "step": float(params.get("learning_rate", 0.1)), "sample": float(params.get("subsample", 1.0)),
    }


def estimator(name: str, params: dict, seed: int = 42, deepest: int = DEEPEST):
    """The Spark classifier that stands for a model name and its parameters."""
    form = spark_form(name, params, deepest)
    common = {
        "featuresCol": "features", "labelCol": "target", "weightCol": "weight", "maxDepth": form["depth"], "seed": seed,
        "minInstancesPerNode": form["rows"], "featureSubsetStrategy": form["features"],
    }
    if name == "random_forest":
        return RandomForestClassifier(numTrees=form["trees"], **common)
    return GBTClassifier(maxIter=form["trees"], stepSize=form["step"], subsamplingRate=form["sample"], **common)


def prepared(samples: DataFrame) -> DataFrame:
    """Samples with ``target`` 0/1 and a weight (1 where none is given)."""
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in samples.columns else F.lit(1.0)
    return samples.withColumns({"target": (F.col("label") > 0).cast("double"), "weight": weight})


def fit(train: DataFrame, features: Sequence[str], name: str, params: dict) -> PipelineModel:
    """Fit on prepared samples; a missing feature is an error, so callers fill or drop such rows in the open."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, estimator(name, params)]).fit(train)


def probability() -> Column:
    return vector_to_array("probability")[1]


def _at_once(task: Callable, items: Sequence, threads: int = 4) -> list:
    with ThreadPool(min(threads, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(task), items)


def fold_list(rows: DataFrame) -> list[tuple[str, int]]:
    """(ticker, fold) pairs whose training and test rows hold both classes: a list as long as tickers x folds."""
    classes = rows.groupBy("ticker", "fold", "role").agg(F.count_distinct("target").alias("_c"))
    good = classes.groupBy("ticker", "fold").agg(F.min("_c").alias("_c"), F.count(F.lit(1)).alias("_r"))
    return [(r["ticker"], r["fold"]) for r in good.filter("_c = 2 AND _r = 2").orderBy("ticker", "fold").collect()]


def fold_rows(samples: DataFrame, folds: DataFrame) -> DataFrame:
    """Prepared samples of all folds with their role; each fit reads only its own ticker and fold."""
    return checkpointed(prepared(samples).join(folds, ["ticker", "ts"]), ["ticker", "fold"])


def fold_predictions(
    rows: DataFrame, features: Sequence[str], name: str, params: dict, pairs: Sequence[tuple[str, int]] | None = None, threads: int = 4
) -> DataFrame:
    """Probabilities of the test rows of each (ticker, fold) under a model fitted on its training rows."""
    pairs = fold_list(rows) if pairs is None else pairs

    def one(pair: tuple[str, int]) -> DataFrame:
        part = rows.filter((F.col("ticker") == pair[0]) & (F.col("fold") == pair[1]))
        model = fit(part.filter("role = 'train'"), features, name, params)
        scored = model.transform(part.filter("role = 'test'"))
        return scored.select("ticker", "ts", "fold", probability().alias("y_prob"), F.col("target").cast("long").alias("y_true"))

    out = None
    for part in _at_once(one, pairs, threads):
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold holds both classes")
    return out


def mean_auc(predictions: DataFrame) -> DataFrame:
    """Mean AUC over folds and their number, per ticker."""
    by_fold = metrics.auc(predictions, ["ticker", "fold"])
    return by_fold.groupBy("ticker").agg(F.avg("auc").alias("score"), F.count(F.lit(1)).alias("n_folds"))


def sampled_grid(grid: dict[str, list], limit: int | None = None, seed: int = 42) -> list[dict]:
    """All combinations of a grid; with ``limit``, so many of them drawn by hash (the same ones on every run)."""
    combos = choices(grid)
    if limit is None or len(combos) <= limit:
        return combos
    texts = [json.dumps(c, sort_keys=True) for c in combos]
    drawn = sorted(texts, key=lambda t: hashlib.md5(f"{seed}:{t}".encode()).hexdigest())[:limit]
    return [json.loads(t) for t in drawn]


def grid_search(rows: DataFrame, features: Sequence[str], name: str, grid: dict[str, list], limit: int | None = None) -> DataFrame:
    """``ticker, rank, params, score, n_folds`` for every combination, or for ``limit`` drawn ones.

    Combinations that mean the same to Spark's trees are fitted once and share their score.
    """
    pairs = fold_list(rows)
    alike: dict[str, list[tuple[int, str]]] = {}
    for rank, params in enumerate(sampled_grid(grid, limit)):
        form = json.dumps(spark_form(name, params), sort_keys=True)
        alike.setdefault(form, []).append((rank, json.dumps(params, sort_keys=True)))
    out = None
    for same in alike.values():
        scored = mean_auc(fold_predictions(rows, features, name, json.loads(same[0][1]), pairs))
        tried = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(p).alias("params")) for k, p in same])
        scored = scored.withColumn("_t", F.explode(tried)).select("ticker", "_t.rank", "_t.params", "score", "n_folds")
        out = scored if out is None else out.unionByName(scored)
    return out


def best_params(results: DataFrame) -> DataFrame:
    """The combination with the highest score per ticker; the first tried wins ties."""
    pick = F.max_by(F.struct("params", "score"), F.struct("score", -F.col("rank"))).alias("_b")
    return results.groupBy("ticker").agg(pick).select("ticker", "_b.*")


def single_feature_auc(samples: DataFrame, features: Sequence[str]) -> DataFrame:
    """AUC of every feature alone, as a score of its own, per ticker; one job for all features."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in features]))
    long = samples.select("ticker", (F.col("label") > 0).cast("long").alias("y_true"), pairs.alias("_p")).select("ticker", "y_true", "_p.*")
    return metrics.auc(long.filter(F.col("score").isNotNull()), ["ticker", "feature"], "score")


def forward_selection(
    rows: DataFrame, features: Sequence[str], name: str = "random_forest", params: dict | None = None, most: int | None = None,
    min_gain: float = 0.001,
) -> list[dict]:
    """Greedy selection for one ticker's rows: add the feature with the best mean fold AUC while it gains.

    The first feature is always taken; ``most`` ends the choice at so many. Each step scores all candidates in one metric job.
    """
    params = params or {"n_estimators": 100, "max_depth": 5}
    pairs = fold_list(rows)
    chosen: list[str] = []
    trace: list[dict] = []
    best = 0.0
    for step in range(len(features) if most is None else min(most, len(features))):
        candidates = [f for f in features if f not in chosen]
        scored = None
        for i, candidate in enumerate(candidates):
            part = fold_predictions(rows, [*chosen, candidate], name, params, pairs).withColumn("_c", F.lit(i))
            scored = part if scored is None else scored.unionByName(part)
        means = metrics.auc(scored, ["_c", "ticker", "fold"]).groupBy("_c").agg(F.avg("auc").alias("auc"))
        # One row: the step's winner.
        winner = means.agg(F.max_by(F.struct("_c", "auc"), F.struct("auc", -F.col("_c"))).alias("w")).first()["w"]
        gain = winner["auc"] - best
        if step and gain < min_gain:
            break
        chosen.append(candidates[winner["_c"]])
        best = winner["auc"]
        trace.append({"step": step + 1, "feature": chosen[-1], "auc": round(best, 4), "gain": round(gain, 4)})
    return trace


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``ticker, ts, signal, prob_up, prob_down, signal_strength``; a tie counts as +1."""
    up = probability()
    scored = model.transform(rows).select("ticker", "ts", up.alias("prob_up"), (1 - up).alias("prob_down"))
    return signals_from(scored)


def signals_from(scored: DataFrame) -> DataFrame:
    """Signals from the probabilities of a rise and a fall."""
    strength = F.col("prob_up") - F.col("prob_down")
    return scored.select(
        "ticker", "ts", F.when(strength < 0, -1).otherwise(1).alias("signal"), "prob_up", "prob_down", strength.alias("signal_strength")
    )


def score_features(model: PipelineModel, table: DataFrame, features: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Score feature rows, missing values filled forward and then by 0."""
    return score(model, fill(table, features, backward=False, default=0.0, block=block))


def predict(model: PipelineModel, table: DataFrame, features: Sequence[str], cut: float = 0.5) -> DataFrame:
    """Labels ±1 and probabilities for complete feature rows."""
    complete = table.dropna("any", subset=list(features))
    p = probability()
    return model.transform(complete).select("ticker", "ts", F.when(p > cut, 1).otherwise(-1).alias("label"), p.alias("probability"))


def train(
    samples: DataFrame, folds: DataFrame, features: Sequence[str], ticker: str, name: str, grid: dict[str, list], most: int | None = None,
    limit: int | None = None,
) -> tuple[PipelineModel, list[str], DataFrame, DataFrame]:
    """Select features, search the grid and fit on all samples of one ticker.

    Returns the model, its features, the search results and the fold predictions of the best parameters.
    """
    rows = fold_rows(samples.filter(F.col("ticker") == ticker), folds)
    chosen = [t["feature"] for t in forward_selection(rows, features, most=most)]
    results = checkpointed(grid_search(rows, chosen, name, grid, limit))
    params = json.loads(best_params(results).first()["params"])
    model = fit(prepared(samples.filter(F.col("ticker") == ticker)), chosen, name, params)
    return model, chosen, results, fold_predictions(rows, chosen, name, params)
