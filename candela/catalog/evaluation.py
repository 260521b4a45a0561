"""Metric queries: predictions derived from hourly bars, strategy returns from daily trade bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.catalog.base import B, D, query, r, shown, with_ctes
from candela.operators import metrics
from candela.operators.timeline import bounded, number
from candela.sources.ticks import event_bars, trade_bars

ALL = "(PARTITION BY ticker ORDER BY pos)"

# Predictions: the close's place in the bar's range as probability of a rise, 150 bars per fold.
P = f"""p0 AS (SELECT *, lead(close) OVER {ALL} AS nx FROM b),
p AS (SELECT ticker, ts, pos, floor((pos - 1) / 150)::BIGINT AS fold, close, coalesce(round((close - low) / nullif(high - low, 0), 2), 0.5) AS y_prob,
  (nx > close)::BIGINT AS y_true FROM p0 WHERE nx IS NOT NULL)"""
# Daily returns of the trade bars.
R = f"""r0 AS (SELECT ticker, ts, pos, close / lag(close) OVER {ALL} - 1 AS ret FROM d),
rt AS (SELECT * FROM r0 WHERE ret IS NOT NULL)"""
# Scaled down so that compounding stays in range.
RS = R + ", rs AS (SELECT ticker, ts, pos, ret * 0.001 AS ret FROM rt)"


def predictions(spark, folder):
    rows = bounded(number(event_bars(spark, folder)), [lambda f: {"nx": f.lead("close")}], back=0, ahead=1)
    place = F.round(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), 2)
    return rows.filter(F.col("nx").isNotNull()).select(
        "ticker", "ts", "pos", F.floor((F.col("pos") - 1) / F.lit(150)).cast("long").alias("fold"), "close",
        F.coalesce(place, F.lit(0.5)).alias("y_prob"), (F.col("nx") > F.col("close")).cast("long").alias("y_true"),
    )


def daily_returns(spark, folder, scale: float = 1.0):
    rows = metrics.simple_returns(number(trade_bars(spark, folder), step=86_400), ["ticker"])
    return rows.select("ticker", "ts", (F.col("ret") * scale).alias("ret"))


_AUC = """au AS (SELECT ticker, fold, coalesce(sum(CASE WHEN x.y_prob > y.y_prob THEN 1.0 WHEN x.y_prob = y.y_prob THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 0.5) AS auc
  FROM (SELECT * FROM p WHERE y_true = 1) x JOIN (SELECT * FROM p WHERE y_true = 0) y USING (ticker, fold) GROUP BY 1, 2)"""
_CLS = """cl AS (SELECT ticker, fold, avg(((y_prob > 0.5)::INT = y_true)::INT) AS accuracy,
  coalesce(count(*) FILTER (WHERE y_prob > 0.5 AND y_true = 1) / nullif(count(*) FILTER (WHERE y_prob > 0.5), 0), 0) AS precision,
  coalesce(count(*) FILTER (WHERE y_prob > 0.5 AND y_true = 1) / nullif(count(*) FILTER (WHERE y_true = 1), 0), 0) AS recall FROM p GROUP BY 1, 2),
cf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM cl)"""
FOLD_W = "(PARTITION BY ticker, fold ORDER BY pos)"
_STRAT = f"""s0 AS (SELECT *, CASE WHEN y_prob > 0.5 THEN 1 ELSE -1 END AS position FROM p),
s AS (SELECT *, coalesce(lag(position) OVER {FOLD_W} * (close / lag(close) OVER {FOLD_W} - 1), 0) AS strategy_return,
  coalesce(lag(position) OVER {FOLD_W} * (close / lag(close) OVER {FOLD_W} - 1), 0)
  - coalesce(abs(position - lag(position) OVER {FOLD_W}), 0) * 0.0001 AS strategy_return_net FROM s0)"""


@query("auc_by_fold", with_ctes(B, P, _AUC, f"SELECT ticker, fold, {r('auc', 'auc')} FROM au"))
def auc_by_fold(spark, folder):
    return shown(metrics.auc(predictions(spark, folder), ["ticker", "fold"]))


@query("auc_one_group", with_ctes(B, P, f"SELECT y.tk AS tk, {r('sum(CASE WHEN x.y_prob > y.y_prob THEN 1.0 WHEN x.y_prob = y.y_prob THEN 0.5 ELSE 0 END) / count(*)', 'auc')} FROM (SELECT *, 'all' AS tk FROM p WHERE y_true = 1) x JOIN (SELECT *, 'all' AS tk FROM p WHERE y_true = 0) y USING (tk) GROUP BY 1"))
def auc_one_group(spark, folder):
    return shown(metrics.auc(predictions(spark, folder).withColumn("tk", F.lit("all")), ["tk"]))


@query(
    "classification_by_fold",
    with_ctes(B, P, _CLS, f"SELECT ticker, fold, {r('accuracy', 'accuracy')}, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')} FROM cf"),
)
def classification_by_fold(spark, folder):
    return shown(metrics.classification(predictions(spark, folder), ["ticker", "fold"]))


@query(
    "fold_metric_averages",
    with_ctes(B, P, _AUC, _CLS, f"SELECT ticker, {r('avg(auc)', 'mean_auc', 4)}, {r('stddev_samp(auc)', 'std_auc', 4)}, {r('avg(accuracy)', 'mean_accuracy', 4)}, {r('avg(f1)', 'mean_f1', 4)} FROM au JOIN cf USING (ticker, fold) GROUP BY 1"),
)
def fold_metric_averages(spark, folder):
    rows = predictions(spark, folder)
    keys = ["ticker", "fold"]
    joined = metrics.auc(rows, keys).join(metrics.classification(rows, keys), keys)
    return shown(
        joined.groupBy("ticker").agg(
            F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"), F.avg("accuracy").alias("mean_accuracy"), F.avg("f1").alias("mean_f1")
        ),
        4,
    )


@query(
    "strategy_returns",
    with_ctes(B, P, _STRAT, f"SELECT ticker, ts, fold, position::BIGINT AS position, {r('strategy_return', 'strategy_return')}, {r('strategy_return_net', 'strategy_return_net')} FROM s"),
)
def strategy_returns(spark, folder):
    out = metrics.strategy_returns(predictions(spark, folder))
    return shown(out.select("ticker", "ts", "fold", "position", "strategy_return", "strategy_return_net"))


@query(
    "reindexed_closes",
    with_ctes(
        B,
        "sp AS (SELECT DISTINCT ts FROM b), tk AS (SELECT DISTINCT ticker FROM b), g AS (SELECT tk.ticker, sp.ts, close FROM sp CROSS JOIN tk LEFT JOIN b ON b.ticker = tk.ticker AND b.ts = sp.ts)",
        "SELECT ticker, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts) AS close FROM g",
    ),
)
def reindexed_closes(spark, folder):
    """Closes brought to the clock of all tickers, gaps filled forward."""
    from candela.operators.panel import align_panel

    return align_panel(event_bars(spark, folder)).select("ticker", "ts", "close")


@query(
    "sharpe_ratios",
    with_ctes(D, R, f"SELECT ticker, {r('sqrt(252) * avg(ret - 0.02 / 252) / stddev_samp(ret - 0.02 / 252)', 'sharpe')} FROM rt GROUP BY 1"),
)
def sharpe_ratios(spark, folder):
    return shown(metrics.sharpe(daily_returns(spark, folder), ["ticker"], risk_free=0.02))


@query(
    "sharpe_population",
    with_ctes(D, R, f"SELECT ticker, {r('sqrt(252) * avg(ret) / stddev_pop(ret)', 'sharpe_252')}, {r('sqrt(8760) * avg(ret) / stddev_pop(ret)', 'sharpe_8760')} FROM rt GROUP BY 1"),
)
def sharpe_population(spark, folder):
    rows = daily_returns(spark, folder)
    a = metrics.sharpe(rows, ["ticker"], population=True).withColumnRenamed("sharpe", "sharpe_252")
    b = metrics.sharpe(rows, ["ticker"], periods=8_760, population=True).withColumnRenamed("sharpe", "sharpe_8760")
    return shown(a.join(b, "ticker"))


_EQ = f"eq AS (SELECT ticker, ts, pos, exp(sum(ln(1 + ret)) OVER {ALL}) AS equity FROM rs), dd AS (SELECT *, max(equity) OVER {ALL} AS peak FROM eq)"


@query("equity_curve", with_ctes(D, RS, _EQ, f"SELECT ticker, ts, {r('equity', 'equity')} FROM eq"))
def equity_curve(spark, folder):
    return shown(metrics.equity(daily_returns(spark, folder, 0.001), ["ticker"]).select("ticker", "ts", "equity"))


@query("max_drawdown", with_ctes(D, RS, _EQ, f"SELECT ticker, {r('min((equity - peak) / peak)', 'max_drawdown')} FROM dd GROUP BY 1"))
def max_drawdown(spark, folder):
    curve = metrics.equity(daily_returns(spark, folder, 0.001), ["ticker"])
    return shown(metrics.max_drawdown(curve, ["ticker"]))


@query("max_drawdown_of_prices", with_ctes(D, f"dp AS (SELECT *, max(close) OVER {ALL} AS peak FROM d)", f"SELECT ticker, {r('min((close - peak) / peak)', 'max_drawdown')} FROM dp GROUP BY 1"))
def max_drawdown_of_prices(spark, folder):
    return shown(metrics.max_drawdown(number(trade_bars(spark, folder), step=86_400), ["ticker"], "close"))


@query(
    "growth_and_calmar",
    with_ctes(
        D, RS, _EQ,
        "en AS (SELECT ticker, arg_min(equity, pos) AS f, arg_max(equity, pos) AS l, count(*) AS n, min((equity - peak) / peak) AS dd FROM dd GROUP BY 1)",
        f"""SELECT ticker, {r('l - 1', 'total_return')}, {r('dd', 'max_drawdown')}, {r('pow(l / f, 252.0 / n) - 1', 'cagr')},
          {r('(pow(l / f, 252.0 / n) - 1) / abs(dd)', 'calmar')}, {r('(pow(l, 252.0 / n) - 1) / abs(dd)', 'calmar_final')} FROM en""",
    ),
)
def growth_and_calmar(spark, folder):
    return shown(metrics.growth(metrics.equity(daily_returns(spark, folder, 0.001), ["ticker"]), ["ticker"]))


@query("sortino_ratios", with_ctes(D, R, f"SELECT ticker, {r('avg(ret) / stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252)', 'sortino')} FROM rt GROUP BY 1"))
def sortino_ratios(spark, folder):
    return shown(metrics.sortino(daily_returns(spark, folder), ["ticker"]))


@query(
    "information_ratios",
    with_ctes(D, R, "bm AS (SELECT ts, avg(ret) AS bench FROM rt GROUP BY 1)", f"SELECT ticker, {r('sqrt(252) * avg(ret - bench) / stddev_samp(ret - bench)', 'information_ratio')} FROM rt JOIN bm USING (ts) GROUP BY 1"),
)
def information_ratios(spark, folder):
    rows = daily_returns(spark, folder)
    bench = rows.groupBy("ts").agg(F.avg("ret").alias("benchmark"))
    return shown(metrics.information_ratio(rows.join(bench, "ts"), ["ticker"]))


@query("skew_and_kurtosis", with_ctes(D, R, f"SELECT ticker, count(*) AS n, {r('skewness(ret)', 'skew')}, {r('kurtosis(ret) + 3', 'kurtosis')} FROM rt GROUP BY 1"))
def skew_and_kurtosis(spark, folder):
    return shown(metrics.moments(daily_returns(spark, folder), ["ticker"]))


@query(
    "deflated_sharpe",
    with_ctes(
        D, R,
        """m AS (SELECT ticker, date_trunc('quarter', ts) AS quarter, sqrt(252) * avg(ret) / stddev_samp(ret) AS s, count(*) AS n, skewness(ret) AS sk,
          kurtosis(ret) + 3 AS ku FROM rt GROUP BY 1, 2)""",
        # What the best of ten trials shows by luck.
        "v AS (SELECT *, (1 - sk * s + (ku - 1) / 4 * s * s) / (n - 1) AS v FROM m)",
        "c AS (SELECT *, CASE WHEN v > 0 THEN least(greatest((s - (sqrt(2 * ln(10)) - 0.5772156649)) / sqrt(v), -40), 40) END AS z FROM v)",
        # The normal distribution by Simpson's rule; beyond 40 deviations nothing is left.
        f"""SELECT ticker, CAST(quarter::DATE AS VARCHAR) AS quarter, {r('coalesce(s, 0)', 'sharpe')}, {r('coalesce(0.5 + z / 12000.0 / sqrt(2 * pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(z * i / 4000.0, 2))), 0)', 'dsr')}
          FROM c CROSS JOIN range(4001) t(i) GROUP BY ticker, quarter, s, z""",
    ),
)
def deflated_sharpe(spark, folder):
    """Ten trials, so that the best one's luck is deducted; per quarter, where ratios above and below it occur."""
    rows = daily_returns(spark, folder).withColumn("quarter", F.to_date(F.date_trunc("quarter", "ts")).cast("string"))
    keys = ["ticker", "quarter"]
    table = metrics.sharpe(rows, keys, periods=252).join(metrics.moments(rows, keys), keys)
    return shown(metrics.deflated_sharpe(table, trials=10).select(*keys, "sharpe", "dsr"))


@query(
    "overfitting_probability",
    with_ctes(
        D, R,
        "cl AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT ts FROM rt GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM rt)))",
        "bl AS (SELECT ts, i // greatest(1, n // 8) AS part FROM cl)",
        "sc AS (SELECT ticker, part, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS score FROM rt JOIN bl USING (ts) WHERE part < 8 GROUP BY 1, 2)",
        "cb AS (SELECT c FROM range(256) t(c) WHERE bit_count(c::BIGINT) = 4)",
        "sd AS (SELECT c, ticker, avg(score) FILTER (WHERE (c >> part) & 1 = 1) AS ins, avg(score) FILTER (WHERE (c >> part) & 1 = 0) AS outs FROM sc CROSS JOIN cb GROUP BY 1, 2)",
        "rk AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY outs DESC) AS rk, row_number() OVER (PARTITION BY c ORDER BY ins DESC, ticker) AS ri, count(*) OVER (PARTITION BY c) AS k FROM sd)",
        f"SELECT {r('avg((rk > k / 2.0)::INT)', 'pbo')}, count(*) AS n_combinations FROM rk WHERE ri = 1",
    ),
)
def overfitting_probability(spark, folder):
    return shown(metrics.overfitting_probability(daily_returns(spark, folder).withColumnRenamed("ticker", "strategy")))


def _pbo_cases(k: int) -> list[str]:
    """The same for the first k times that all strategies share: p blocks, and p over p / 2 combinations."""
    return [
        "cl AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT ts FROM rt GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM rt)))",
        f"c2 AS (SELECT ts, i, count(*) OVER () AS n FROM cl WHERE i < {k})",
        "bl AS (SELECT ts, i // greatest(1, n // 8) AS part, least(8, n) AS p FROM c2)",
        "sc AS (SELECT ticker, part, p, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS score FROM rt JOIN bl USING (ts) WHERE part < p GROUP BY 1, 2, 3)",
        "cb AS (SELECT c, p FROM range(256) t(c), (SELECT DISTINCT p FROM bl) WHERE c < pow(2, p) AND bit_count(c::BIGINT) = p // 2)",
        "sd AS (SELECT c, ticker, avg(score) FILTER (WHERE (c >> part) & 1 = 1) AS ins, avg(score) FILTER (WHERE (c >> part) & 1 = 0) AS outs FROM sc JOIN cb USING (p) GROUP BY 1, 2)",
        "rk AS (SELECT *, avg(r) OVER (PARTITION BY c, outs) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY outs DESC) AS r, row_number() OVER (PARTITION BY c ORDER BY ins DESC, ticker) AS ri, count(*) OVER (PARTITION BY c) AS k FROM sd))",
    ]


@query(
    "overfitting_probability_few_times",
    with_ctes(D, R, *_pbo_cases(5), f"SELECT {r('avg((rk > k / 2.0)::INT)', 'pbo')}, count(*) AS n_combinations FROM rk WHERE ri = 1"),
)
def overfitting_probability_few_times(spark, folder):
    """Fewer times than blocks: five blocks, ten combinations, and ties because one row has no deviation."""
    rows = daily_returns(spark, folder).withColumnRenamed("ticker", "strategy")
    shared = rows.groupBy("ts").agg(F.count_distinct("strategy").alias("k"))
    shared = shared.filter(F.col("k") == rows.agg(F.count_distinct("strategy")).scalar())
    first = shared.orderBy("ts").limit(5).select("ts")
    return shown(metrics.overfitting_probability(rows.join(first, "ts", "left_semi")))


@query("overfitting_probability_one_strategy", "SELECT 0.0::DOUBLE AS pbo, 0::BIGINT AS n_combinations")
def overfitting_probability_one_strategy(spark, folder):
    """Nothing can be overfitted with one strategy."""
    rows = daily_returns(spark, folder).withColumnRenamed("ticker", "strategy")
    return shown(metrics.overfitting_probability(rows.withColumn("strategy", F.lit("one")).dropDuplicates(["ts"])))


# Covariances over the times that have every ticker.
_PAIRS = """rc AS (SELECT * FROM rt WHERE ret IS NOT NULL AND ts IN (SELECT ts FROM rt GROUP BY 1 HAVING count(ret) = (SELECT count(DISTINCT ticker) FROM rt))),
pr AS (SELECT x.ticker AS a, y.ticker AS b, covar_samp(x.ret, y.ret) AS cov, corr(x.ret, y.ret) AS corr
  FROM rc x JOIN rc y USING (ts) GROUP BY 1, 2)"""


@query("covariance_and_correlation", with_ctes(D, R, _PAIRS, f"SELECT a, b, {r('cov', 'cov')}, {r('corr', 'corr')} FROM pr"))
def covariance_and_correlation(spark, folder):
    return shown(metrics.pair_moments(daily_returns(spark, folder)).drop("rows"))


@query("mean_correlation", with_ctes(D, R, _PAIRS, f"SELECT {r('avg(corr)', 'mean_corr')} FROM pr WHERE a < b"))
def mean_correlation(spark, folder):
    return shown(metrics.mean_correlation(metrics.pair_moments(daily_returns(spark, folder))))


@query(
    "win_rate_gain_loss",
    with_ctes(D, R, f"SELECT ticker, {r('avg((ret > 0)::INT)', 'win_rate')}, {r('avg(ret) FILTER (WHERE ret > 0)', 'avg_gain')}, {r('abs(avg(ret) FILTER (WHERE ret < 0))', 'avg_loss')} FROM rt GROUP BY 1"),
)
def win_rate_gain_loss(spark, folder):
    return shown(metrics.win_loss(daily_returns(spark, folder), ["ticker"]))


@query(
    "fold_evaluation",
    with_ctes(
        B, P, _AUC, _CLS, _STRAT,
        """sh AS (SELECT ticker, fold, coalesce(sqrt(252) * avg(strategy_return_net) / nullif(stddev_samp(strategy_return_net), 0), 0) AS sharpe,
          coalesce(sqrt(252) * avg(strategy_return) / nullif(stddev_samp(strategy_return), 0), 0) AS sharpe_gross FROM s GROUP BY 1, 2)""",
        f"SELECT ticker, fold, {r('auc', 'auc')}, {r('accuracy', 'accuracy')}, {r('f1', 'f1')}, {r('sharpe', 'sharpe')}, {r('sharpe_gross', 'sharpe_gross')} FROM au JOIN cf USING (ticker, fold) JOIN sh USING (ticker, fold)",
    ),
)
def fold_evaluation(spark, folder):
    from candela.plans.evaluation import evaluate_folds

    return shown(evaluate_folds(predictions(spark, folder)).select("ticker", "fold", "auc", "accuracy", "f1", "sharpe", "sharpe_gross"))


@query("evaluation_report")
def evaluation_report(spark, folder):
    """One row per ticker: averaged fold metrics, compounded returns, deflated Sharpe and the folds as an array."""
    from candela.plans.evaluation import report

    return report(predictions(spark, folder))
