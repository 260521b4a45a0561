"""Sweep and model queries on hourly event bars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from candela.catalog.base import B, query, r, shown, with_ctes
from candela.catalog.bars import scratch
from candela.catalog.evaluation import P, predictions
from candela.catalog.events import _EVENTS, _VOL, cusum_cte, lr_cte, samples, sigma_cte
from candela.operators import events as ev
from candela.operators import metrics, splits
from candela.operators import labels as lab
from candela.operators.timeline import number
from candela.plans import sweeps, training
from candela.plans.evaluation import evaluate_folds
from candela.session import checkpointed
from candela.sources import store
from candela.sources.ticks import event_bars

KS = [0.37, 0.83, 1.41, 2.17]
PAIRS = [(0.1, 0.1), (0.4, 0.2), (0.2, 0.4)]
HORIZONS = [6, 24]
FEATURES = ["mean_20", "volume_20"]
CUTOFF = datetime(2024, 1, 21)
SMALL = {"n_estimators": 5, "max_depth": 3}

_GRID = [
    lr_cte(), sigma_cte("sg0", "lr", 100),
    "sg AS (SELECT sg0.*, k FROM sg0 CROSS JOIN (VALUES (0.37::DOUBLE), (0.83::DOUBLE), (1.41::DOUBLE), (2.17::DOUBLE)) t(k))",
    cusum_cte("cu", "sg", "k * sigma", keys="ticker, k"),
    "nb AS (SELECT ticker, count(*) AS n FROM b GROUP BY 1)",
    "ra AS (SELECT ticker, k, count(*) FILTER (WHERE fired) AS n_events, count(*) FILTER (WHERE fired) / any_value(n) AS share FROM cu JOIN nb USING (ticker) GROUP BY 1, 2)",
]


@query("sweep_event_sensitivity", with_ctes(B, *_GRID, f"SELECT ticker, k, n_events::BIGINT AS n_events, {r('share', 'ratio', 4)} FROM ra", recursive=True))
def sweep_event_sensitivity(spark, folder):
    ratios = sweeps.event_ratios(sweeps.event_grid(event_bars(spark, folder), KS), KS)
    return shown(ratios.select("ticker", "k", "n_events", "ratio"), 4)


@query("best_event_sensitivity", with_ctes(
    B, *_GRID,
    """rk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY (share NOT BETWEEN 0.05 AND 0.3),
      CASE WHEN share BETWEEN 0.05 AND 0.3 THEN abs(share - sqrt(0.015)) ELSE abs(round(share, 4) - sqrt(0.015)) END, k) AS i FROM ra)""",
    f"SELECT ticker, k AS best_k, {r('share', 'best_ratio', 4)} FROM rk WHERE i = 1", recursive=True,
))
def best_event_sensitivity(spark, folder):
    ratios = sweeps.event_ratios(sweeps.event_grid(event_bars(spark, folder), KS), KS)
    return shown(sweeps.best_k(ratios, 0.05, 0.3).drop("rank"), 4)


_SWEEP = [
    *_EVENTS, _VOL,
    """st AS (SELECT e.ticker, b.pos, b.close AS p0, coalesce(CASE WHEN v > 0 THEN v END, 0.01) AS sg, pt, sl, h, i FROM e JOIN b USING (ticker, ts) JOIN vs USING (ticker, pos)
      CROSS JOIN (VALUES (0.1::DOUBLE, 0.1::DOUBLE, 0), (0.4, 0.2, 1), (0.2, 0.4, 2)) x(pt, sl, i) CROSS JOIN (VALUES (6), (24)) y(h))""",
    """fp AS (SELECT st.ticker, st.pos, p0, pt, sl, h, i, max(q.pos) AS e, arg_max(q.close, q.pos) AS pe, min(q.pos) FILTER (WHERE q.close >= p0 * (1 + pt * sg)) AS u,
      min(q.pos) FILTER (WHERE q.close <= p0 * (1 - sl * sg)) AS d FROM st JOIN b q ON q.ticker = st.ticker AND q.pos > st.pos AND q.pos <= st.pos + h GROUP BY ALL)""",
    """bl AS (SELECT ticker, pt, sl, h AS bars_ahead, i, count(*) AS n_labels, count(*) FILTER (WHERE CASE WHEN u IS NOT NULL AND (d IS NULL OR u <= d) THEN true
      WHEN d IS NOT NULL THEN false ELSE pe > p0 END) AS n_positive FROM fp GROUP BY 1, 2, 3, 4, 5)""",
]


def _balances(spark, folder):
    bars = number(event_bars(spark, folder))
    return sweeps.barrier_balances(ev.cusum(bars, 2.05), bars, PAIRS, HORIZONS)


@query("sweep_barriers", with_ctes(B, *_SWEEP, f"SELECT ticker, pt, sl, bars_ahead::BIGINT AS bars_ahead, n_labels, n_positive, {r('n_positive / n_labels', 'balance', 4)} FROM bl", recursive=True))
def sweep_barriers(spark, folder):
    return shown(_balances(spark, folder).drop("rank", "share"), 4)


@query("best_barriers", with_ctes(
    B, *_SWEEP, "rk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(n_positive / n_labels - 0.5), i, bars_ahead) AS k FROM bl)",
    f"SELECT ticker, pt, sl, bars_ahead::BIGINT AS bars_ahead, {r('n_positive / n_labels', 'balance', 4)} FROM rk WHERE k = 1", recursive=True,
))
def best_barriers(spark, folder):
    return shown(sweeps.best_barriers(_balances(spark, folder)), 4)


@query("auto_search_labels")
def auto_search_labels(spark, folder):
    """Best sensitivity and barriers per ticker, then the labels they give."""
    labels, _ = sweeps.auto_labels(event_bars(spark, folder), KS, PAIRS, HORIZONS)
    return shown(lab.label_summary(labels).fillna({"label": 0, "barrier": "all"}))


@query("best_of_results", with_ctes(
    B, P,
    "g AS (SELECT ticker, fold, avg((y_prob > c)::INT = y_true) AS acc, c FROM (SELECT * FROM p CROSS JOIN (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) t(c)) GROUP BY ticker, fold, c)".replace("avg((y_prob > c)::INT = y_true)", "avg(((y_prob > c)::INT = y_true)::INT)"),
    "m AS (SELECT ticker, c, round(avg(acc), 6) AS s FROM g GROUP BY 1, 2)",
    "SELECT ticker, c AS cut, s + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY s DESC, c) AS k FROM m) WHERE k = 1",
))
def best_of_results(spark, folder):
    """The best of several candidates by mean fold score, the first on ties."""
    rows = predictions(spark, folder)
    out = None
    for rank, cut in enumerate((0.3, 0.5, 0.7)):
        scores = metrics.classification(rows, ["ticker", "fold"], cut=cut).groupBy("ticker").agg(F.round(F.avg("accuracy"), 6).alias("score"))
        part = scores.select("ticker", F.lit(rank).alias("rank"), F.lit(str(cut)).alias("params"), "score")
        out = part if out is None else out.unionByName(part)
    best = training.best_params(out)
    return best.select("ticker", F.col("params").cast("double").alias("cut"), "score")


def model_samples(spark, folder):
    rows, _ = samples(spark, folder)
    rows = checkpointed(lab.with_weights(splits.complete(rows, FEATURES)))
    folds = splits.walk_forward(rows.select("ticker", "ts", "t1"), 2, 0.2, 30)
    return rows, folds


@query("single_feature_auc", with_ctes(
    B, *_EVENTS,
    "f AS (SELECT e.ticker, e.ts, b.pos FROM e JOIN b USING (ticker, ts)), nx AS (SELECT b.*, lead(close) OVER (PARTITION BY ticker ORDER BY pos) AS nx FROM b)",
    "s AS (SELECT ticker, open, volume, nx > close AS up FROM f JOIN nx USING (ticker, pos) WHERE nx IS NOT NULL)",
    "l AS (SELECT ticker, 'open' AS feature, open AS x, up FROM s UNION ALL SELECT ticker, 'volume', volume, up FROM s)",
    f"SELECT ticker, feature, {r('sum(CASE WHEN p.x > n.x THEN 1.0 WHEN p.x = n.x THEN 0.5 ELSE 0 END) / count(*)', 'auc')} FROM (SELECT * FROM l WHERE up) p JOIN (SELECT * FROM l WHERE NOT up) n USING (ticker, feature) GROUP BY 1, 2",
    recursive=True,
))
def single_feature_auc(spark, folder):
    """How well each feature alone orders the labels (label: does the next close rise?)."""
    from candela.operators.timeline import bounded

    bars = number(event_bars(spark, folder))
    ahead = bounded(bars, [lambda f: {"nx": f.lead("close")}], back=0, ahead=1).filter("nx IS NOT NULL")
    rows = ahead.join(ev.cusum(bars, 2.05), ["ticker", "ts"]).withColumn("label", F.when(F.col("nx") > F.col("close"), 1).otherwise(-1))
    return shown(training.single_feature_auc(rows, ["open", "volume"]))


@query("model_fold_predictions")
def model_fold_predictions(spark, folder):
    """A random forest fitted on the training rows of each ticker and fold, scored on its test rows."""
    rows, folds = model_samples(spark, folder)
    return training.fold_predictions(training.fold_rows(rows, folds), FEATURES, "random_forest", SMALL)


@query("model_fold_metrics")
def model_fold_metrics(spark, folder):
    """Fold metrics of a boosted-tree model, net of commission."""
    rows, folds = model_samples(spark, folder)
    scored = training.fold_predictions(training.fold_rows(rows, folds), FEATURES, "xgboost", {"n_estimators": 3, "max_depth": 2})
    closes = event_bars(spark, folder).select("ticker", "ts", "close")
    return evaluate_folds(checkpointed(scored.join(closes, ["ticker", "ts"])))


@query("model_grid_search")
def model_grid_search(spark, folder):
    rows, folds = model_samples(spark, folder)
    results = training.grid_search(training.fold_rows(rows, folds), FEATURES, "random_forest", {"n_estimators": [3, 5], "max_depth": [2]})
    return training.best_params(checkpointed(results))


@query("model_feature_selection")
def model_feature_selection(spark, folder):
    """Greedy choice of features over the folds of all tickers together."""
    rows, folds = model_samples(spark, folder)
    rows = rows.withColumn("ticker", F.lit("all"))
    folds = splits.walk_forward(rows.groupBy("ticker", "ts").agg(F.max("t1").alias("t1")), 2, 0.2, 30)  # a time ends with its last label
    trace = training.forward_selection(training.fold_rows(rows, folds), FEATURES, params=SMALL)
    return spark.createDataFrame([(t["step"], t["feature"], t["auc"], t["gain"]) for t in trace], "step int, feature string, auc double, gain double")


@query("model_signals")
def model_signals(spark, folder):
    """Fit before the cutoff, store, load, and score every bar from the cutoff on."""
    from candela.catalog.events import small_features

    rows, _ = model_samples(spark, folder)
    model = training.fit(training.prepared(rows.filter(F.col("t1") < F.lit(CUTOFF))), FEATURES, "random_forest", SMALL)
    path = scratch(spark, "model")
    store.save_model(spark, path, model, FEATURES, {}, CUTOFF)
    loaded, names, _ = store.load_model(spark, path, CUTOFF)
    table = small_features(number(event_bars(spark, folder)))
    return training.score_features(loaded, table, names).filter(F.col("ts") >= F.lit(CUTOFF))


@query("model_predictions_for_complete_rows")
def model_predictions_for_complete_rows(spark, folder):
    from candela.catalog.events import small_features

    rows, _ = model_samples(spark, folder)
    model = training.fit(training.prepared(rows), FEATURES, "random_forest", SMALL)
    return training.predict(model, small_features(number(event_bars(spark, folder))), FEATURES)


@query("signals_from_probabilities", with_ctes(B, P, f"SELECT ticker, ts, CASE WHEN y_prob - (1 - y_prob) < 0 THEN -1 ELSE 1 END::BIGINT AS signal, {r('y_prob', 'prob_up')}, {r('1 - y_prob', 'prob_down')}, {r('y_prob - (1 - y_prob)', 'signal_strength')} FROM p"))
def signals_from_probabilities(spark, folder):
    rows = predictions(spark, folder).select("ticker", "ts", F.col("y_prob").alias("prob_up"), (1 - F.col("y_prob")).alias("prob_down"))
    return shown(training.signals_from(rows))


@query("sampled_parameter_grid", with_ctes(
    B,
    "nb AS (SELECT ticker, count(*) AS n_bars FROM b GROUP BY 1)",
    """gr AS (SELECT '{"max_depth": ' || coalesce(d, 'null') || ', "max_features": "' || f || '", "min_samples_leaf": ' || l || ', "min_samples_split": ' || s || ', "n_estimators": ' || n || '}' AS params
      FROM (VALUES ('3'), ('5'), ('7'), (NULL)) a(d), (VALUES ('sqrt'), ('log2')) c(f), (VALUES (1), (2), (4)) e(l), (VALUES (2), (5), (10)) g(s), (VALUES (100), (200), (300)) h(n))""",
    "SELECT ticker, n_bars, params FROM nb CROSS JOIN (SELECT params FROM gr ORDER BY md5('42:' || params) LIMIT 20)",
))
def sampled_parameter_grid(spark, folder):
    """Twenty combinations of the forest grid drawn by hash, for each ticker's bars."""
    import json

    texts = [json.dumps(c, sort_keys=True) for c in training.sampled_grid(training.GRIDS["random_forest"], 20)]
    bars = event_bars(spark, folder).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"))
    return bars.withColumn("params", F.explode(F.lit(texts)))
