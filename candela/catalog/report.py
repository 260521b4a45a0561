"""Report queries over daily results derived from the event bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.catalog.base import B, query, r, shown, with_ctes
from candela.catalog.evaluation import _AUC, _STRAT, P, predictions
from candela.catalog.portfolio import _ACCOUNT, _PANEL_DAILY, results
from candela.operators import panel, report
from candela.operators.timeline import number
from candela.plans.evaluation import evaluate_folds
from candela.sources.ticks import event_bars

# One profile's results with confidence and rounded allocations.
RES = [
    B, _PANEL_DAILY, _ACCOUNT,
    "cf AS (SELECT date, least(max(close - 5000) / 1700.0, 1.0) AS c FROM dl GROUP BY 1)",
    """rs AS (SELECT 'mid' AS profile, ac.date, portfolio_value, benchmark_value, regime, optimizer, round(c, 4) AS confidence,
      row_number() OVER (ORDER BY ac.date) AS day FROM ac JOIN cf USING (date))""",
    "al AS (SELECT date, ticker, round(w, 4) AS w FROM hw WHERE date IN (SELECT date FROM rs))",
]


def res(spark, folder):
    return results(spark, folder)


@query("regime_shares", with_ctes(*RES, "SELECT profile, upper(regime[1]) || regime[2:] AS name, count(*) AS days, round(count(*) * 100.0 / sum(count(*)) OVER ())::BIGINT AS pct FROM rs GROUP BY profile, regime"))
def regime_shares(spark, folder):
    return report.shares(res(spark, folder), "regime").withColumn("name", report.label("name"))


@query("optimizer_shares", with_ctes(*RES, "SELECT profile, optimizer AS name, count(*) AS days, round(count(*) * 100.0 / sum(count(*)) OVER ())::BIGINT AS pct FROM rs GROUP BY 1, 2"))
def optimizer_shares(spark, folder):
    return report.shares(res(spark, folder), "optimizer")


_SUMMARY = [
    *RES,
    "ss AS (SELECT *, portfolio_value / lag(portfolio_value) OVER (ORDER BY date) - 1 AS ret, max(portfolio_value) OVER (ORDER BY date) AS peak FROM rs)",
]


@query("result_summary", with_ctes(
    *_SUMMARY,
    f"""SELECT profile, count(*) AS days, {r('(arg_max(portfolio_value, date) / arg_min(portfolio_value, date) - 1) * 100', 'total_return')},
      {r('(arg_max(portfolio_value, date) / arg_min(portfolio_value, date) - arg_max(benchmark_value, date) / arg_min(benchmark_value, date)) * 100', 'vs_benchmark')},
      {r('arg_max(portfolio_value, date) - arg_min(portfolio_value, date)', 'profit')}, {r('min((portfolio_value - peak) / peak) * 100', 'max_drawdown')},
      {r('avg(ret) / stddev_pop(ret) * sqrt(252)', 'sharpe')}, {r('avg(confidence)', 'mean_confidence')} FROM ss GROUP BY 1""",
))
def result_summary(spark, folder):
    return shown(report.summary(res(spark, folder)))


@query("mean_confidence_per_day", with_ctes(B, P, f"SELECT ts::DATE AS date, {r('avg(least(greatest(y_prob, 0.5), 1.0))', 'confidence')} FROM p GROUP BY 1"))
def mean_confidence_per_day(spark, folder):
    from candela.plans.backtest import mean_confidence

    rows = predictions(spark, folder).select(F.to_date("ts").alias("date"), F.col("y_prob").alias("prob_up"))
    return shown(mean_confidence(rows))


@query("asset_names", with_ctes(*RES, "SELECT DISTINCT ticker AS asset FROM al ORDER BY 1"))
def asset_names(spark, folder):
    return report.asset_names(res(spark, folder))


_CHART = f"""ch AS (SELECT profile, day, round(portfolio_value * 25) AS portfolio, round(benchmark_value * 25) AS benchmark, strftime(date, '%Y-%m') AS month,
  (SELECT round(w * 100, 4) FROM al WHERE al.date = rs.date AND ticker = 'click') AS click, (SELECT round(w * 100, 4) FROM al WHERE al.date = rs.date AND ticker = 'view') AS view, 0.0::DOUBLE AS other FROM rs)"""


@query("chart_rows", with_ctes(*RES, _CHART, "SELECT * FROM ch"))
def chart_rows(spark, folder):
    return shown(report.chart_rows(res(spark, folder), ["click", "view", "other"]), 4)


@query("chart_every_tenth", with_ctes(*RES, _CHART, "SELECT * FROM ch WHERE (day - 1) % 10 = 0 OR day = (SELECT max(day) FROM ch)"))
def chart_every_tenth(spark, folder):
    return shown(report.every_tenth(report.chart_rows(res(spark, folder), ["click", "view", "other"])), 4)


@query("top_allocations", with_ctes(*RES, "SELECT 'mid' AS profile, date, ticker AS asset, w AS weight, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, ticker) AS rk FROM al WHERE w > 0.005) WHERE rk <= 5"))
def top_allocations(spark, folder):
    return shown(report.top_allocations(res(spark, folder)))


@query("top_three_allocations", with_ctes(*RES, "SELECT 'mid' AS profile, date, ticker AS asset, w AS weight, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, ticker) AS rk FROM al WHERE w > 0.005) WHERE rk <= 3"))
def top_three_allocations(spark, folder):
    return shown(report.top_allocations(res(spark, folder), 3))


@query("last_allocations", with_ctes(*RES, "SELECT 'mid' AS profile, ticker AS name, round(w * 100, 1) + 0.0 AS value FROM al WHERE date = (SELECT max(date) FROM al) AND round(w * 100, 1) > 0.1 ORDER BY 3 DESC"))
def last_allocations(spark, folder):
    return report.last_allocations(res(spark, folder))


@query("performance_fee", with_ctes(
    *RES,
    "fe AS (SELECT *, 25000 * portfolio_value / first_value(portfolio_value) OVER (ORDER BY date) AS value FROM rs)",
    f"SELECT profile, day, {r('value', 'value')}, {r('greatest(0, value - 25000) * 0.03', 'fee')}, {r('value - greatest(0, value - 25000) * 0.03', 'net')} FROM fe",
))
def performance_fee(spark, folder):
    return shown(report.after_fee(res(spark, folder), 25_000, 0.03))


@query("latest_prediction", with_ctes(B, P, "SELECT ticker, max(ts) AS ts, arg_max(y_prob, ts) AS y_prob, arg_max(close, ts) AS close FROM p GROUP BY 1"))
def latest_prediction(spark, folder):
    return panel.latest(predictions(spark, folder), ["y_prob", "close"])


@query("every_tenth_bar", with_ctes(B, "SELECT ticker, ts, close FROM (SELECT *, max(pos) OVER (PARTITION BY ticker) AS n FROM b) WHERE (pos - 1) % 10 = 0 OR pos = n"))
def every_tenth_bar(spark, folder):
    return panel.thin(number(event_bars(spark, folder)), ["ticker"]).select("ticker", "ts", "close")


@query("fold_predictions_in_time_order", with_ctes(B, P, "SELECT ticker, ts, fold, y_prob FROM p WHERE fold = 1 UNION ALL SELECT ticker, ts, fold, y_prob FROM p WHERE fold = 3 ORDER BY 1, 2"))
def fold_predictions_in_time_order(spark, folder):
    rows = predictions(spark, folder).select("ticker", "ts", "fold", "y_prob")
    return rows.filter("fold = 3").unionByName(rows.filter("fold = 1")).orderBy("ticker", "ts")


@query("train_against_test", with_ctes(
    B, P, _AUC, _STRAT,
    "sh AS (SELECT ticker, fold, coalesce(sqrt(252) * avg(strategy_return_net) / nullif(stddev_samp(strategy_return_net), 0), 0) AS sharpe FROM s GROUP BY 1, 2)",
    *_SUMMARY[1:],
    f"""SELECT 'mid' AS profile, ticker, {r('avg(auc)', 'train_auc')}, {r('avg(sh.sharpe)', 'train_sharpe')},
      (SELECT count(*) FROM ss) AS test_days, (SELECT round(avg(ret) / stddev_pop(ret) * sqrt(252), 6) FROM ss) AS test_sharpe,
      (SELECT round(min((portfolio_value - peak) / peak) * 100, 6) FROM ss) AS test_max_drawdown FROM au JOIN sh USING (ticker, fold) GROUP BY ticker""",
))
def train_against_test(spark, folder):
    folds = evaluate_folds(predictions(spark, folder)).groupBy("ticker").agg(F.avg("auc").alias("auc"), F.avg("sharpe").alias("sharpe"))
    tested = report.summary(res(spark, folder)).select("profile", "days", "sharpe", "max_drawdown")
    return shown(report.train_against_test(folds.withColumn("profile", F.lit("mid")), tested))
