"""Panel, regime and weight queries on daily trade bars (three series) and hourly event bars (five)."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.catalog.base import B, D, query, r, shown, with_ctes
from candela.catalog.evaluation import R, daily_returns
from candela.operators import metrics, panel, portfolio, trailing
from candela.operators.timeline import number
from candela.plans import backtest
from candela.session import checkpointed
from candela.sources.ticks import event_bars, trade_bars

DAY = 86_400


def signals(spark, folder):
    """Signals from the candle: where the close lies between open, high and low."""
    span = F.try_divide(F.col("close") - F.col("open"), F.col("high") - F.col("low"))
    p = F.round(0.5 + 0.5 * F.coalesce(span, F.lit(0.0)), 4)
    return trade_bars(spark, folder).select("ticker", "ts", p.alias("prob_up"), (2 * p - 1).alias("signal_strength"))


def days_of(df):
    return df.select(F.to_date("ts").alias("date")).distinct()


S = "sig AS (SELECT ticker, ts, round(0.5 + 0.5 * coalesce((close - open) / nullif(high - low, 0), 0), 4) AS prob_up FROM d)"

# Clock panel, returns, trailing windows of each day, and the complete rows in them.
W = """sp AS (SELECT DISTINCT ts FROM d), tk AS (SELECT DISTINCT ticker FROM d),
g AS (SELECT tk.ticker, sp.ts, close, d.ts AS obs FROM sp CROSS JOIN tk LEFT JOIN d ON d.ticker = tk.ticker AND d.ts = sp.ts),
pn AS (SELECT ticker, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts) AS close,
  last_value(obs IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts) AS seen FROM g),
pr AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY ts) - 1 AS ret, lag(seen) OVER (PARTITION BY ticker ORDER BY ts) AS bef FROM pn),
sl AS (SELECT x.ts AS date, pr.*, x.ts - INTERVAL 365 DAY AS st FROM sp x JOIN pr ON pr.ts BETWEEN x.ts - INTERVAL 365 DAY AND x.ts),
ow AS (SELECT date, ticker FROM sl GROUP BY 1, 2 HAVING count(*) FILTER (WHERE seen = ts) >= 30),
nt AS (SELECT date, count(*) AS n_tickers FROM ow GROUP BY 1),
rw AS (SELECT sl.* FROM sl JOIN ow USING (date, ticker)),
tm AS (SELECT date, ts, n_tickers, count(*) FILTER (WHERE ret IS NOT NULL AND bef >= st) AS v, count(*) FILTER (WHERE seen >= st) AS p FROM rw JOIN nt USING (date) GROUP BY 1, 2, 3),
px AS (SELECT date, n_tickers, count(*) AS price_rows FROM tm WHERE p > 0 GROUP BY 1, 2),
wr AS (SELECT rw.date, rw.ts, rw.ticker, ret FROM rw JOIN tm USING (date, ts) WHERE ret IS NOT NULL AND bef >= st AND v = n_tickers)"""

REGIME = """tl AS (SELECT date, ts FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ts DESC) AS k FROM (SELECT DISTINCT date, ts FROM wr)) WHERE k <= 60),
lt AS (SELECT wr.* FROM wr JOIN tl USING (date, ts)),
ms AS (SELECT date, ticker, avg(ret) AS m, stddev_samp(ret) AS s FROM lt GROUP BY 1, 2),
fs AS (SELECT date, ticker, stddev_samp(ret) AS s FROM wr GROUP BY 1, 2),
mm AS (SELECT ms.date, avg(ms.m) * 252 AS mean_return, avg(ms.s) * sqrt(252) / (avg(fs.s) * sqrt(252) + 1e-10) * 100 AS vol_ratio FROM ms JOIN fs USING (date, ticker) GROUP BY 1),
cr AS (SELECT date, avg(c) AS mean_corr FROM (SELECT x.date, x.ticker, y.ticker, corr(x.ret, y.ret) AS c FROM lt x JOIN lt y ON x.date = y.date AND x.ts = y.ts AND x.ticker < y.ticker GROUP BY 1, 2, 3) GROUP BY 1),
rg AS (SELECT px.date, price_rows, n_tickers, mean_return, vol_ratio, coalesce(mean_corr, 0) AS mean_corr, CASE WHEN price_rows < 120 THEN 'neutral' WHEN vol_ratio > 80 AND mean_corr > 0.65 THEN 'crisis'
  WHEN mean_return < -0.05 THEN 'bear' WHEN mean_return > 0.05 AND NOT vol_ratio > 80 THEN 'bull' ELSE 'neutral' END AS regime FROM px LEFT JOIN mm USING (date) LEFT JOIN cr USING (date))"""


def windows(spark, folder):
    bars = number(trade_bars(spark, folder), step=DAY)
    return panel.window_returns(bars, days_of(bars))


def facts_of(spark, folder, logs: bool = False):
    """The facts of each day's trailing year and its price rows."""
    bars = number(trade_bars(spark, folder), step=DAY)
    facts, price_rows = trailing.window_facts(bars, days_of(bars), logs=logs)
    return checkpointed(facts), price_rows


@query("latest_signal_per_day", with_ctes(
    B,
    "sg AS (SELECT ticker, ts, close AS x FROM b WHERE pos % 30 = 0), dy AS (SELECT DISTINCT ts::DATE AS date FROM b), tk AS (SELECT DISTINCT ticker FROM sg)",
    """SELECT k.ticker, k.date, sg.x FROM (SELECT * FROM dy CROSS JOIN tk) k ASOF JOIN sg ON sg.ticker = k.ticker AND sg.ts < k.date + INTERVAL 1 DAY""".replace("sg.ts < k.date + INTERVAL 1 DAY", "k.date + INTERVAL 1 DAY > sg.ts"),
))
def latest_signal_per_day(spark, folder):
    """As-of: the last signal on or before each day."""
    bars = number(event_bars(spark, folder))
    sparse = bars.filter("pos % 30 = 0").select("ticker", "ts", F.col("close").alias("x"))
    return panel.latest_on_day(sparse, days_of(bars), ["x"])


@query("trailing_year_slices", with_ctes(D, W, f"SELECT date::DATE AS date, ticker, count(*) AS n, {r('stddev_samp(ret)', 'volatility')} FROM wr GROUP BY 1, 2"))
def trailing_year_slices(spark, folder):
    returns = panel.unpacked(windows(spark, folder)[0])
    return shown(returns.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("ret").alias("volatility")))


@query("panel_outer_filled", with_ctes(D, W.split("pr AS")[0].rstrip().rstrip(","), "SELECT ticker, ts, close FROM pn"))
def panel_outer_filled(spark, folder):
    return panel.align_panel(number(trade_bars(spark, folder), step=DAY)).select("ticker", "ts", "close")


_DAILY = """dl AS (SELECT ticker, ts::DATE AS date, arg_max(close, ts) AS close FROM b GROUP BY 1, 2),
dr AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0) AS ret FROM dl)"""
_WEIGHTS = "wt AS (SELECT date, ticker, close / sum(close) OVER (PARTITION BY date) AS weight FROM dl WHERE ticker <> 'view')"


def daily(spark, folder):
    return panel.daily_returns(panel.daily_last(event_bars(spark, folder)))


def price_weights(prices):
    """Weights in proportion to the close, without one ticker."""
    rows = prices.filter("ticker <> 'view'")
    total = rows.groupBy("date").agg(F.sum("close").alias("_t"))
    return rows.join(total, "date").select("date", "ticker", F.try_divide("close", "_t").alias("weight"))


@query("daily_returns_filled", with_ctes(B, _DAILY, f"SELECT ticker, date, close, {r('ret', 'ret')} FROM dr"))
def daily_returns_filled(spark, folder):
    return shown(daily(spark, folder))


@query("weights_times_next_returns", with_ctes(
    B, _DAILY, _WEIGHTS,
    "nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM dr))",
    f"SELECT wt.date, {r('sum(weight * ret)', 'ret')} FROM wt JOIN nx USING (date) JOIN dr ON dr.date = nd AND dr.ticker = wt.ticker GROUP BY 1",
))
def weights_times_next_returns(spark, folder):
    rows = daily(spark, folder)
    return shown(panel.next_day_returns(price_weights(rows), rows))


@query("weights_for_universe", with_ctes(
    B, _DAILY, _WEIGHTS,
    f"SELECT x.date, t.ticker, {r('coalesce(weight, 0) / sum(coalesce(weight, 0)) OVER (PARTITION BY x.date)', 'weight')} FROM (SELECT DISTINCT date FROM wt) x CROSS JOIN (SELECT DISTINCT ticker FROM dl) t LEFT JOIN wt ON wt.date = x.date AND wt.ticker = t.ticker",
))
def weights_for_universe(spark, folder):
    rows = daily(spark, folder)
    return shown(panel.spread_weights(price_weights(rows), rows, ["date"]))


_OLD = "od AS (SELECT date + 1 AS date, ticker, weight FROM wt)"
_CHANGE = """ch AS (SELECT coalesce(od.date, wt.date) AS date, max(abs(coalesce(wt.weight, 0) - coalesce(od.weight, 0))) AS max_change
  FROM od FULL JOIN wt ON od.date = wt.date AND od.ticker = wt.ticker GROUP BY 1)"""


def old_and_new(spark, folder):
    new = price_weights(daily(spark, folder))
    return new.select((F.date_add("date", 1)).alias("date"), "ticker", "weight"), new


@query("largest_weight_change", with_ctes(B, _DAILY, _WEIGHTS, _OLD, _CHANGE, f"SELECT date, {r('max_change', 'max_change')} FROM ch"))
def largest_weight_change(spark, folder):
    old, new = old_and_new(spark, folder)
    return shown(panel.weight_change(old, new, ["date"]))


@query("threshold_rebalance_step", with_ctes(
    B, _DAILY, _WEIGHTS, _OLD, _CHANGE,
    f"""SELECT date, ticker, {r('weight', 'weight')} FROM od WHERE date IN (SELECT date FROM ch WHERE max_change < 0.3)
      UNION ALL SELECT date, ticker, round(weight, 6) + 0.0 FROM wt WHERE date NOT IN (SELECT date FROM ch WHERE max_change < 0.3 AND date IN (SELECT date FROM od))""",
))
def threshold_rebalance_step(spark, folder):
    old, new = old_and_new(spark, folder)
    return shown(panel.keep_small_changes(old, new, ["date"], 0.3))


@query("threshold_rebalance_walk", with_ctes(
    B, _DAILY, _WEIGHTS,
    "pk AS (SELECT date, row_number() OVER (ORDER BY date) AS k, list(weight ORDER BY ticker) AS w FROM wt GROUP BY 1)",
    """hw AS (SELECT date, k, w FROM pk WHERE k = 1 UNION ALL
      SELECT pk.date, pk.k, CASE WHEN list_max(list_transform(list_zip(hw.w, pk.w), lambda z: abs(z[1] - z[2]))) < 0.4 THEN hw.w ELSE pk.w END FROM hw JOIN pk ON pk.k = hw.k + 1)""",
    f"SELECT 'p' AS profile, date, x.ticker, {r('w[x.i]', 'weight')} FROM hw CROSS JOIN (SELECT ticker, row_number() OVER (ORDER BY ticker) AS i FROM (SELECT DISTINCT ticker FROM wt)) x",
    recursive=True,
))
def threshold_rebalance_walk(spark, folder):
    """Kept weights feed into the next day's comparison."""
    new = price_weights(daily(spark, folder)).withColumn("profile", F.lit("p"))
    return shown(portfolio.hold_small_changes(new, 0.4))


# ---- regime and weights ------------------------------------------------------------------------


@query("market_regime", with_ctes(
    D, W, REGIME,
    f"""SELECT date::DATE AS date, price_rows, n_tickers, {r('mean_return', 'mean_return', 5)}, {r('vol_ratio', 'vol_ratio', 5)}, {r('mean_corr', 'mean_corr', 5)}, regime,
      CASE WHEN regime = 'bull' THEN 'Kelly' WHEN regime IN ('bear', 'crisis') THEN 'HRP' ELSE 'Black-Litterman' END AS optimizer FROM rg""",
))
def market_regime(spark, folder):
    facts, price_rows = facts_of(spark, folder)
    facts = portfolio.regime(portfolio.regime_facts(facts, price_rows))
    return shown(facts.withColumn("optimizer", portfolio.optimizer_for("regime")), 5)


CAP = """cp AS (SELECT date, 0 AS k, list_transform(w, lambda x: greatest(x, 0) / list_sum(list_transform(w, lambda y: greatest(y, 0)))) AS w FROM pk
    WHERE list_sum(list_transform(w, lambda y: greatest(y, 0))) > 0
  UNION ALL SELECT date, k + 1, list_transform(w, lambda x: CASE WHEN x > 0.45 THEN 0.45 ELSE x + coalesce(
    (list_sum(list_filter(w, lambda y: y > 0.45)) - 0.45 * len(list_filter(w, lambda y: y > 0.45))) / nullif(len(w) - len(list_filter(w, lambda y: y > 0.45)), 0), 0) END)
    FROM cp WHERE k < 200 AND len(list_filter(w, lambda y: y > 0.45)) > 0),
cl AS (SELECT date, arg_max(w, k) AS w FROM cp GROUP BY 1),
ce AS (SELECT date, list_transform(w, lambda x: x / list_sum(w)) AS w FROM cl UNION ALL
  SELECT date, list_transform(w, lambda x: 1.0 / len(w)) FROM pk WHERE date NOT IN (SELECT date FROM cl))"""
OUT = "SELECT date{c} AS date, x.ticker, round(w[x.i], 5) + 0.0 AS weight FROM ce CROSS JOIN (SELECT ticker, row_number() OVER (ORDER BY ticker) AS i FROM (SELECT DISTINCT ticker FROM {t})) x"


@query("capped_weights", with_ctes(B, _DAILY, "pk AS (SELECT date, list(close - 20 ORDER BY ticker) AS w FROM dl GROUP BY 1)", CAP, OUT.format(c="", t="dl"), recursive=True))
def capped_weights(spark, folder):
    raw = daily(spark, folder).select("date", "ticker", (F.col("close") - 20).alias("weight"))
    return shown(portfolio.cap_weights(raw, ["date"], 0.45), 5)


@query("kelly_weights", with_ctes(
    D, W, S,
    """kl AS (SELECT date, ticker, avg((ret > 0)::INT) AS wr, coalesce(avg(ret) FILTER (WHERE ret > 0), 0.01) AS g, coalesce(abs(avg(ret) FILTER (WHERE ret < 0)), 0.01) AS l, count(*) AS n FROM wr GROUP BY 1, 2),
    kq AS (SELECT kl.*, least(greatest(0.5 + (2 * prob_up - 1) * 0.7 * 0.3 + (wr - 0.5) * 0.2, 0.01), 0.99) AS p, g / (l + 1e-10) AS b FROM kl JOIN (SELECT k.date, k.ticker, sig.prob_up FROM (SELECT DISTINCT date, ticker FROM wr) k ASOF JOIN sig ON sig.ticker = k.ticker AND k.date >= sig.ts) q USING (date, ticker)),
    pk AS (SELECT date, list(CASE WHEN n >= 20 THEN greatest((p * b - (1 - p)) / (b + 1e-10), 0) * 0.5 ELSE 0 END ORDER BY ticker) AS w FROM kq GROUP BY 1)""",
    CAP, "nm AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY ticker) AS i FROM kq)",
    "SELECT date::DATE AS date, ticker, round(w[i], 5) + 0.0 AS weight FROM ce JOIN nm USING (date)", recursive=True,
))
def kelly_weights(spark, folder):
    facts = portfolio.kelly_facts(facts_of(spark, folder)[0])
    strength = panel.latest_on_day(signals(spark, folder), days_of(trade_bars(spark, folder)), ["signal_strength"])
    return shown(portfolio.kelly_weights(facts, strength.withColumnRenamed("signal_strength", "strength"), cap=0.45), 5)


def matrices(facts):
    return metrics.mirrored(facts.select("date", "a", "b", "cov", "corr", "rows"), ["date"])


def _moments(spark, folder):
    strength = panel.latest_on_day(signals(spark, folder), days_of(trade_bars(spark, folder)), ["signal_strength"])
    return matrices(facts_of(spark, folder)[0]), strength.withColumnRenamed("signal_strength", "strength")


@query("hrp_weights")
def hrp_weights(spark, folder):
    return portfolio.hrp_weights(*_moments(spark, folder), cap=0.45)


@query("black_litterman_weights")
def black_litterman_weights(spark, folder):
    return portfolio.black_litterman_weights(*_moments(spark, folder), cap=0.45)


@query("mean_variance_weights")
def mean_variance_weights(spark, folder):
    """Mean-variance weights of each trailing year, starting from equal weights."""
    facts, _ = facts_of(spark, folder)
    means = facts.filter("a = b").select("date", F.col("a").alias("ticker"), F.col("mean").alias("mu")).withColumn("previous", F.lit(1.0 / 3.0))
    return portfolio.mean_variance_weights(matrices(facts), means)


@query("risk_parity_weights")
def risk_parity_weights(spark, folder):
    """Hierarchical risk parity on log returns of each trailing year, without tilt or cap."""
    moments = matrices(facts_of(spark, folder, logs=True)[0])
    return portfolio.plain_hrp_weights(moments, moments.select("date", F.col("a").alias("ticker")).distinct(), linkage="average")


def _engine_signals(spark, folder):
    last = panel.latest(signals(spark, folder), ["signal_strength"])
    return last.select("ticker", F.when(F.col("signal_strength") > 0, 1).otherwise(-1).alias("signal"))


@query("engine_weights")
def engine_weights(spark, folder):
    bars = number(trade_bars(spark, folder), step=DAY)
    return backtest.engine_weights(bars, _engine_signals(spark, folder), "high")


@query("money_allocation", with_ctes(B, _DAILY, _WEIGHTS, f"SELECT date, {r('sum(100000 * weight)', 'total_allocated', 4)}, count(*) FILTER (WHERE weight > 1e-5) AS n_long FROM wt GROUP BY 1"))
def money_allocation(spark, folder):
    money = portfolio.allocation(price_weights(daily(spark, folder)), 100_000)
    return shown(portfolio.allocation_summary(money, ["date"]), 4)


# ---- accounting --------------------------------------------------------------------------------

# Weights on every seventh day only, so that the days between keep the last ones.
_PANEL_DAILY = """sp AS (SELECT DISTINCT ts FROM b), tk AS (SELECT DISTINCT ticker FROM b),
g AS (SELECT tk.ticker, sp.ts, last_value(close IGNORE NULLS) OVER (PARTITION BY tk.ticker ORDER BY sp.ts) AS close FROM sp CROSS JOIN tk LEFT JOIN b ON b.ticker = tk.ticker AND b.ts = sp.ts),
dl AS (SELECT ticker, ts::DATE AS date, arg_max(close, ts) + 5000 AS close FROM g WHERE close IS NOT NULL GROUP BY 1, 2),
dr AS (SELECT *, (coalesce(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1, 0)) AS ret FROM dl)"""
_ACCOUNT = """sd AS (SELECT date, ticker, (close - 5000) / sum(close - 5000) OVER (PARTITION BY date) AS weight FROM dl WHERE ticker <> 'view' AND day(date) % 7 = 0),
dy AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM dr)),
us AS (SELECT dy.date, nd, max(s.date) AS wd FROM dy LEFT JOIN (SELECT DISTINCT date FROM sd) s ON s.date <= dy.date GROUP BY 1, 2),
hw AS (SELECT us.date, nd, wd, t.ticker, CASE WHEN wd IS NULL THEN 0.2 ELSE coalesce(sd.weight, 0) END AS w FROM us CROSS JOIN (SELECT DISTINCT ticker FROM dl) t LEFT JOIN sd ON sd.date = wd AND sd.ticker = t.ticker),
pf AS (SELECT hw.date, wd, sum(w * ret) AS p, sum(0.2 * ret) AS q FROM hw JOIN dr ON dr.date = nd AND dr.ticker = hw.ticker GROUP BY 1, 2),
ac AS (SELECT date, wd, round(1000 * exp(sum(ln(1 + p)) OVER (ORDER BY date)), 4) AS portfolio_value, round(1000 * exp(sum(ln(1 + q)) OVER (ORDER BY date)), 4) AS benchmark_value,
  CASE WHEN wd IS NULL THEN 'neutral' WHEN day(wd) % 2 = 0 THEN 'bull' ELSE 'bear' END AS regime, CASE WHEN wd IS NULL THEN 'Black-Litterman' WHEN day(wd) % 2 = 0 THEN 'Kelly' ELSE 'HRP' END AS optimizer FROM pf)"""


def results(spark, folder, commission_bps: float = 0.0):
    """Daily results from simple weights: every seventh day in proportion to the close; prices are
    lifted by 5000 so that compounding stays in range."""
    bars = number(event_bars(spark, folder))
    prices = checkpointed(panel.daily_last(panel.align_panel(bars)).filter("close IS NOT NULL"))
    weights = price_weights(prices.filter("day(date) % 7 = 0")).withColumn("profile", F.lit("mid"))
    even = F.dayofmonth("date") % 2 == 0
    states = weights.select("date").distinct().select(
        "date", F.when(even, "bull").otherwise("bear").alias("regime"), F.when(even, "Kelly").otherwise("HRP").alias("optimizer")
    )
    sure = prices.groupBy("date").agg(F.least(F.max("close") / 1_700.0, F.lit(1.0)).alias("confidence"))
    lifted = bars.withColumn("close", F.col("close") + 5_000)
    return backtest.account(weights, states, lifted, sure, commission_bps=commission_bps)


@query("daily_accounting", with_ctes(B, _PANEL_DAILY, _ACCOUNT, "SELECT date, portfolio_value + 0.0 AS portfolio_value, benchmark_value + 0.0 AS benchmark_value, regime, optimizer FROM ac"))
def daily_accounting(spark, folder):
    return results(spark, folder).select("date", "portfolio_value", "benchmark_value", "regime", "optimizer")


@query("daily_accounting_with_commission", with_ctes(
    B, _PANEL_DAILY, _ACCOUNT,
    "tn AS (SELECT date, sum(m) AS moved FROM (SELECT date, coalesce(abs(w - lag(w) OVER (PARTITION BY ticker ORDER BY date)), 0) AS m FROM hw) GROUP BY 1)",
    "SELECT ac.date, round(1000 * exp(sum(ln(1 + p - moved * 0.0005)) OVER (ORDER BY ac.date)), 4) + 0.0 AS portfolio_value, benchmark_value + 0.0 AS benchmark_value, ac.regime FROM ac JOIN pf USING (date) JOIN tn USING (date)",
))
def daily_accounting_with_commission(spark, folder):
    return results(spark, folder, 5.0).select("date", "portfolio_value", "benchmark_value", "regime")


@query("backtest_profiles")
def backtest_profiles(spark, folder):
    """Regime, weights and daily accounting of the three profiles over the trade bars."""
    bars = number(trade_bars(spark, folder), step=DAY)
    out = backtest.run_profiles(bars, signals(spark, folder), backtest.PROFILES)
    return out.withColumn("allocations", F.map_entries("allocations"))
