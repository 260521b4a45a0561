"""Indicator, normaliser and timeframe queries (hourly event bars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.catalog.base import B, ewm_cte, ewmstd_cte, query, r, shown, with_ctes
from candela.operators import indicators as ind
from candela.operators.timeline import number
from candela.plans import features as plan
from candela.sources.ticks import event_bars

KEY = ["ticker", "ts"]


def _run(spark, folder, *indicators, bars=None):
    out = ind.compute(event_bars(spark, folder) if bars is None else bars, indicators, keep=KEY)
    return shown(out)


def _sql(select: str, *ctes: str, source: str = "b") -> str:
    return with_ctes(B, *ctes, f"SELECT ticker, ts, {select} FROM {source}")


W = "(PARTITION BY ticker ORDER BY pos ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def w(n: int) -> str:
    return W.format(n - 1)


ALL = "(PARTITION BY ticker ORDER BY pos)"


def _full(agg: str, x: str, n: int, need: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} >= {need or n} THEN {agg}({x}) OVER {w(n)} END"


@query(
    "willr",
    with_ctes(
        B,
        f"x AS (SELECT *, {_full('max', 'high', 14)} AS hh, {_full('min', 'low', 14)} AS ll FROM b)",
        f"SELECT ticker, ts, {r('-100 * (hh - close) / nullif(hh - ll, 0)', 'willr_14')} FROM x",
    ),
)
def willr(spark, folder):
    return _run(spark, folder, ind.willr("willr_14", 14))


@query(
    "vwap",
    _sql(r(f"sum((high + low + close) / 3.0 * volume) OVER {ALL} / nullif(sum(volume) OVER {ALL}, 0)", "vwap")),
)
def vwap(spark, folder):
    return _run(spark, folder, ind.vwap("vwap"))


@query(
    "cmf",
    with_ctes(
        B,
        "m AS (SELECT *, ((close - low) - (high - close)) / nullif(high - low, 0) * volume AS f FROM b)",
        f"SELECT ticker, ts, {r('(' + _full('sum', 'f', 5) + ') / nullif(sum(volume) OVER ' + w(5) + ', 0)', 'cmf_5')} FROM m",
    ),
)
def cmf(spark, folder):
    return _run(spark, folder, ind.cmf("cmf_5", 5))


@query(
    "cci",
    with_ctes(
        B,
        f"t AS (SELECT *, (high + low + close) / 3.0 AS tp FROM b)",
        f"m AS (SELECT *, {_full('avg', 'tp', 20)} AS mean FROM t)",
        """k AS (SELECT a.ticker, a.pos, avg(abs(c.tp - a.mean)) AS mad FROM m a JOIN m c
          ON a.ticker = c.ticker AND c.pos BETWEEN a.pos - 19 AND a.pos GROUP BY 1, 2)""",
        f"SELECT m.ticker, m.ts, {r('(tp - mean) / (0.015 * nullif(mad, 0))', 'cci_20')} FROM m JOIN k USING (ticker, pos)",
    ),
)
def cci(spark, folder):
    return _run(spark, folder, ind.cci("cci_20", 20))


@query(
    "bbands",
    with_ctes(
        B,
        f"m AS (SELECT *, {_full('avg', 'close', 20)} AS m, {_full('stddev_samp', 'close', 20)} AS s FROM b)",
        f"SELECT ticker, ts, {r('m + 2 * s', 'bb_upper_20')}, {r('m - 2 * s', 'bb_lower_20')}, {r('m', 'bb_middle_20')} FROM m",
    ),
)
def bbands(spark, folder):
    return _run(spark, folder, ind.bbands(["bb_upper_20", "bb_lower_20", "bb_middle_20"], 20, 2.0))


@query(
    "order_flow_imbalance",
    with_ctes(
        B,
        f"s AS (SELECT *, sign(nullif(close - lag(close) OVER {ALL}, 0)) AS d FROM b)",
        f"f AS (SELECT *, last_value(d IGNORE NULLS) OVER {ALL} AS side FROM s)",
        f"""g AS (SELECT *, sum(CASE WHEN side = 1 THEN volume ELSE 0 END) OVER {w(20)} AS buy,
          sum(CASE WHEN side = -1 THEN volume ELSE 0 END) OVER {w(20)} AS sell FROM f)""",
        f"SELECT ticker, ts, {r('(buy - sell) / nullif(buy + sell, 0)', 'ofi_20')} FROM g",
    ),
)
def order_flow_imbalance(spark, folder):
    return _run(spark, folder, ind.ofi("ofi_20", 20))


@query(
    "transaction_rate",
    with_ctes(
        B,
        f"s AS (SELECT *, abs(close - lag(close) OVER {ALL}) AS d FROM b)",
        f"SELECT ticker, ts, {r(f'avg(d) OVER {w(20)} / nullif(avg(volume) OVER {w(20)}, 0)', 'trans_rate_20')} FROM s",
    ),
)
def transaction_rate(spark, folder):
    return _run(spark, folder, ind.trans_rate("trans_rate_20", 20))


@query(
    "tick_autocorrelation",
    with_ctes(
        B,
        f"s AS (SELECT *, close / lag(close) OVER {ALL} - 1 AS ret FROM b)",
        f"p AS (SELECT *, lag(ret) OVER {ALL} AS prev FROM s)",
        f"SELECT ticker, ts, {r(f'CASE WHEN count(ret) OVER {w(20)} >= 20 THEN corr(ret, prev) OVER {w(19)} END', 'tick_autocorr_20')} FROM p",
    ),
)
def tick_autocorrelation(spark, folder):
    return _run(spark, folder, ind.tick_autocorr("tick_autocorr_20", 20))


_CHANGE = f"ch AS (SELECT *, close - lag(close) OVER {ALL} AS chg FROM b)"


@query(
    "rsi",
    with_ctes(
        B,
        _CHANGE,
        "gl AS (SELECT *, CASE WHEN chg IS NOT NULL THEN greatest(chg, 0) END AS gain, CASE WHEN chg IS NOT NULL THEN greatest(-chg, 0) END AS loss FROM ch)",
        ewm_cte("g", "gl", "gain", 1 / 14, 14),
        ewm_cte("l", "gl", "loss", 1 / 14, 14),
        f"SELECT ticker, ts, {r('100 - 100 / (1 + g.v / nullif(l.v, 0))', 'rsi_14')} FROM b JOIN g USING (ticker, pos) JOIN l USING (ticker, pos)",
    ),
)
def rsi(spark, folder):
    return _run(spark, folder, ind.rsi("rsi_14", 14))


@query(
    "macd",
    with_ctes(
        B,
        ewm_cte("f", "b", "close", 2 / 13, 12),
        ewm_cte("s", "b", "close", 2 / 27, 26),
        "m AS (SELECT ticker, b.ts, pos, f.v - s.v AS line FROM b JOIN f USING (ticker, pos) JOIN s USING (ticker, pos))",
        ewm_cte("g", "m", "line", 2 / 10, 9),
        f"SELECT ticker, ts, {r('line', 'macd_line')}, {r('g.v', 'macd_signal')}, {r('line - g.v', 'macd_hist')} FROM m JOIN g USING (ticker, pos)",
    ),
)
def macd(spark, folder):
    return _run(spark, folder, ind.macd(["macd_line", "macd_signal", "macd_hist"]))


_TR = f"""pv AS (SELECT *, lag(close) OVER {ALL} AS pc, lag(high) OVER {ALL} AS ph, lag(low) OVER {ALL} AS pl FROM b),
tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS up,
  CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dn FROM pv)"""


@query(
    "atr",
    with_ctes(
        B, _TR, ewm_cte("a", "tr", "tr", 1 / 14, 14),
        f"SELECT ticker, ts, {r('a.v', 'atr_14')} FROM b JOIN a USING (ticker, pos)",
    ),
)
def atr(spark, folder):
    return _run(spark, folder, ind.atr("atr_14", 14))


@query(
    "adx",
    with_ctes(
        B, _TR,
        ewm_cte("a", "tr", "tr", 1 / 14, 14), ewm_cte("u", "tr", "up", 1 / 14, 14), ewm_cte("dw", "tr", "dn", 1 / 14, 14),
        """di AS (SELECT ticker, pos, 100 * u.v / nullif(a.v, 0) AS p, 100 * dw.v / nullif(a.v, 0) AS m
          FROM a JOIN u USING (ticker, pos) JOIN dw USING (ticker, pos))""",
        "dx AS (SELECT ticker, pos, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM di)",
        ewm_cte("x", "dx", "dx", 1 / 14, 14),
        f"SELECT ticker, ts, {r('x.v', 'adx_14')} FROM b JOIN x USING (ticker, pos)",
    ),
)
def adx(spark, folder):
    return _run(spark, folder, ind.adx("adx_14", 14))


@query(
    "supertrend",
    with_ctes(
        B, _TR, ewm_cte("a", "tr", "tr", 1 / 10, 10),
        """bands AS (SELECT ticker, ts, pos, close, (high + low) / 2 + 1.5 * a.v AS u, (high + low) / 2 - 1.5 * a.v AS l
          FROM b JOIN a USING (ticker, pos))""",
        """st AS (SELECT ticker, pos, 1 AS side, u, l, CAST(NULL AS DOUBLE) AS line FROM bands WHERE pos = 1
          UNION ALL
          SELECT ticker, pos, side, u, l, CASE WHEN side = 1 THEN l ELSE u END FROM (
            SELECT n.ticker, n.pos,
              CASE WHEN n.close > s.u THEN 1 WHEN n.close < s.l THEN -1 ELSE s.side END AS side,
              CASE WHEN coalesce(n.close > s.u, false) OR coalesce(n.close < s.l, false) OR s.side = 1 OR coalesce(n.u <= s.u, true) THEN n.u ELSE s.u END AS u,
              CASE WHEN coalesce(n.close > s.u, false) OR coalesce(n.close < s.l, false) OR s.side = -1 OR coalesce(n.l >= s.l, true) THEN n.l ELSE s.l END AS l
            FROM st s JOIN bands n ON n.ticker = s.ticker AND n.pos = s.pos + 1))""",
        f"SELECT ticker, ts, {r('line', 'supertrend_10')} FROM b JOIN st USING (ticker, pos)",
        recursive=True,
    ),
)
def supertrend(spark, folder):
    return _run(spark, folder, ind.supertrend("supertrend_10", 10, 1.5))


@query(
    "mfi",
    with_ctes(
        B,
        "t AS (SELECT *, (high + low + close) / 3.0 AS tp FROM b)",
        f"t2 AS (SELECT *, lag(tp) OVER {ALL} AS ptp FROM t)",
        f"""t3 AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS up,
          CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS dn FROM t2)""",
        f"SELECT ticker, ts, {r('100 - 100 / (1 + (' + _full('sum', 'up', 14) + ') / nullif(' + _full('sum', 'dn', 14) + ', 0))', 'mfi_14')} FROM t3",
    ),
)
def mfi(spark, folder):
    return _run(spark, folder, ind.mfi("mfi_14", 14))


@query(
    "obv",
    with_ctes(
        B,
        f"s AS (SELECT *, coalesce(sign(close - lag(close) OVER {ALL}), 0) AS d FROM b)",
        f"SELECT ticker, ts, {r(f'sum(volume * d) OVER {ALL}', 'obv', 4)} FROM s",
    ),
)
def obv(spark, folder):
    return shown(ind.compute(event_bars(spark, folder), [ind.obv("obv")], keep=KEY), 4)


@query(
    "ema_and_deviation",
    with_ctes(
        B, ewm_cte("m", "b", "close", 2 / 21, 20), ewmstd_cte("s", "b", "close", 2 / 21, 20),
        f"SELECT ticker, ts, {r('m.v', 'ema_20')}, {r('s.v', 'emstd_20')} FROM b JOIN m USING (ticker, pos) JOIN s USING (ticker, pos)",
    ),
)
def ema_and_deviation(spark, folder):
    return _run(spark, folder, ind.ema("ema_20", 20), ind.ema_std("emstd_20", 20))


@query(
    "ema_distance",
    with_ctes(
        B, ewm_cte("m", "b", "close", 2 / 21, 20),
        f"SELECT ticker, ts, {r('(close - m.v) / nullif(m.v, 0) * 100', 'ems_pct_20')} FROM b JOIN m USING (ticker, pos)",
    ),
)
def ema_distance(spark, folder):
    return _run(spark, folder, ind.ems_pct("ems_pct_20", 20))


@query(
    "normalise_quantile",
    with_ctes(
        B,
        """k AS (SELECT a.ticker, a.pos, count(*) AS n, count(*) FILTER (WHERE c.close < a.close) AS ls,
          count(*) FILTER (WHERE c.close = a.close) AS eq FROM b a JOIN b c
          ON a.ticker = c.ticker AND c.pos BETWEEN a.pos - 47 AND a.pos GROUP BY 1, 2)""",
        f"SELECT ticker, ts, {r('CASE WHEN n >= 24 THEN (ls + (eq + 1) / 2.0) / n END', 'close__quantiles')} FROM b JOIN k USING (ticker, pos)",
    ),
)
def normalise_quantile(spark, folder):
    return _run(spark, folder, ind.quantile_rank("close__quantiles", "close", 48))


@query(
    "normalise_zscore_mean",
    with_ctes(
        B,
        f"m AS (SELECT *, {_full('avg', 'close', 30, 15)} AS m, {_full('stddev_samp', 'close', 30, 15)} AS s FROM b)",
        f"SELECT ticker, ts, {r('(close - m) / nullif(s, 0)', 'close__zscore')}, {r('close - m', 'close__mean_sub')}, {r('close / nullif(m, 0)', 'close__mean_div')} FROM m",
    ),
)
def normalise_zscore_mean(spark, folder):
    return _run(
        spark, folder,
        ind.zscore("close__zscore", "close", 30),
        ind.mean_subtraction("close__mean_sub", "close", 30),
        ind.mean_division("close__mean_div", "close", 30),
    )


@query(
    "normalise_ema",
    with_ctes(
        B, ewm_cte("m", "b", "close", 2 / 49, 48),
        f"SELECT ticker, ts, {r('(close - m.v) / nullif(m.v, 0)', 'close__ema_norm')} FROM b JOIN m USING (ticker, pos)",
    ),
)
def normalise_ema(spark, folder):
    return _run(spark, folder, ind.ema_norm("close__ema_norm", "close", 48))


@query(
    "smoothing",
    with_ctes(
        B, ewm_cte("m", "b", "close", 2 / 6, 5),
        f"""z AS (SELECT ticker, pos, ts, {_full('avg', 'close', 5)} AS sma,
          (5 * close + 4 * lag(close, 1) OVER {ALL} + 3 * lag(close, 2) OVER {ALL} + 2 * lag(close, 3) OVER {ALL}
          + lag(close, 4) OVER {ALL}) / 15.0 AS wma FROM b)""",
        f"SELECT ticker, ts, {r('m.v', 'ema5')}, {r('sma', 'sma5')}, {r('wma', 'wma5')} FROM z JOIN m USING (ticker, pos)",
    ),
)
def smoothing(spark, folder):
    return _run(spark, folder, *[ind.smooth(f"{k}5", "close", 5, k) for k in ("ema", "sma", "wma")])


_DAY0 = "d0x AS (SELECT ticker, date_trunc('day', min(ts)) AS day0 FROM b GROUP BY 1)"


def _bin(minutes: int) -> str:
    return f"bins AS (SELECT b.*, (epoch(b.ts) - epoch(day0))::BIGINT // {minutes * 60} AS bin FROM b JOIN d0x USING (ticker))"


@query(
    "timeframe_hold",
    with_ctes(
        B, _DAY0, _bin(240),
        """v AS (SELECT ticker, bin, arg_min(open, pos) AS o, max(high) AS h, min(low) AS l, arg_max(close, pos) AS c,
          sum(volume) AS vol, avg(close) AS m FROM bins GROUP BY 1, 2)""",
        f"""SELECT ticker, ts, o AS open_4h, h AS high_4h, l AS low_4h, c AS close_4h, {r('vol', 'volume_4h')},
          {r('m', 'mean_4h')} FROM bins JOIN v USING (ticker, bin)""",
    ),
)
def timeframe_hold(spark, folder):
    columns = {f"{c}_4h": (c, a) for c, a in ind.HOLD_AGG.items()} | {"mean_4h": ("close", "mean")}
    out = ind.hold(event_bars(spark, folder), 60, 240, columns, mode="hold")
    return shown(out.select(*KEY, *columns))


@query(
    "timeframe_closed",
    with_ctes(
        B, _DAY0, _bin(420),
        "v AS (SELECT ticker, bin, max(pos) AS upto, max(high) AS h, arg_max(close, pos) AS c, sum(volume) AS vol FROM bins GROUP BY 1, 2)",
        """SELECT b.ticker, b.ts, v.h AS high_7h, v.c AS close_7h, round(v.vol, 6) + 0.0 AS volume_7h
          FROM b ASOF LEFT JOIN (SELECT *, upto + 1 AS seen FROM v) v ON b.ticker = v.ticker AND b.pos >= v.seen""",
    ),
)
def timeframe_closed(spark, folder):
    columns = {f"{c}_7h": (c, ind.HOLD_AGG[c]) for c in ("high", "close", "volume")}
    out = ind.hold(event_bars(spark, folder), 60, 420, columns, mode="closed")
    return shown(out.select(*KEY, *columns))


@query(
    "returns_and_realised_volatility",
    with_ctes(
        B, _DAY0, _bin(240),
        "v AS (SELECT ticker, bin, arg_max(close, pos) AS c FROM bins GROUP BY 1, 2)",
        "h AS (SELECT ticker, ts, pos, c FROM bins JOIN v USING (ticker, bin))",
        f"x AS (SELECT *, c / lag(c, 4) OVER {ALL} AS q FROM h)",
        f"y AS (SELECT *, q - 1 AS rt FROM x)",
        f"""SELECT ticker, ts, {r('rt', 'r4h_return', 5)}, {r('ln(q)', 'r4h_log_return', 5)},
          {r(_full('stddev_samp', 'rt', 80, 40), 'r4h_realized_vol', 5)} FROM y""",
    ),
)
def returns_and_realised_volatility(spark, folder):
    held = ind.hold(event_bars(spark, folder), 60, 240, {"c4": ("close", "last")}, mode="hold")
    out = ind.compute(held, [ind.returns("r4h", 4, "c4")], keep=KEY)
    return shown(out, 5)


@query(
    "volatility_ew",
    with_ctes(
        B,
        f"lr AS (SELECT *, ln(close / lag(close) OVER {ALL}) AS x FROM b)",
        ewmstd_cte("s", "lr", "x", 2 / 101, 50),
        f"SELECT ticker, ts, {r('s.v', 'volatility')} FROM b JOIN s USING (ticker, pos)",
    ),
)
def volatility_ew(spark, folder):
    return _run(spark, folder, ind.ew_volatility("volatility", 100))


@query(
    "rolling_function",
    with_ctes(
        B,
        f"SELECT ticker, ts, {r(f'CASE WHEN count(*) OVER {w(10)} = 10 THEN median(close) OVER {w(10)} END', 'close_median_10')} FROM b",
    ),
)
def rolling_function(spark, folder):
    """A rolling median given as a function of the window's values."""
    def median(values):
        ranked = F.array_sort(values)
        return (F.element_at(ranked, 5) + F.element_at(ranked, 6)) / 2.0

    return _run(spark, folder, ind.rolling("close_median_10", 10, median))


@query(
    "indicator_grid",
    with_ctes(
        B, _DAY0, _bin(240),
        "v AS (SELECT ticker, bin, max(high) AS h, min(low) AS l, arg_max(close, pos) AS c FROM bins GROUP BY 1, 2)",
        """g AS (SELECT ticker, ts, pos, '1h' AS tf, high AS h, low AS l, close AS c FROM b UNION ALL
          SELECT ticker, ts, pos, '4h', v.h, v.l, v.c FROM bins JOIN v USING (ticker, bin))""",
        """wr AS (SELECT ticker, ts, tf, n, CASE WHEN k >= n THEN -100 * (hh - c) / nullif(hh - ll, 0) END AS x FROM (
          SELECT g.ticker, g.ts, g.tf, n, g.c, count(p.h) AS k, max(p.h) AS hh, min(p.l) AS ll FROM g CROSS JOIN (VALUES (5), (14)) t(n)
          JOIN g p ON p.ticker = g.ticker AND p.tf = g.tf AND p.pos BETWEEN g.pos - n + 1 AND g.pos GROUP BY 1, 2, 3, 4, 5))""",
        f"""SELECT ticker, ts, {r("max(x) FILTER (WHERE tf = '1h' AND n = 5)", '"1h_willr_5"')},
          {r("max(x) FILTER (WHERE tf = '1h' AND n = 14)", '"1h_willr_14"')},
          {r("max(x) FILTER (WHERE tf = '4h' AND n = 5)", '"4h_willr_5"')},
          {r("max(x) FILTER (WHERE tf = '4h' AND n = 14)", '"4h_willr_14"')} FROM wr GROUP BY 1, 2""",
    ),
)
def indicator_grid(spark, folder):
    """One indicator on a parameter grid and several timeframes; timeframes below the bars are skipped."""
    bars = number(event_bars(spark, folder))
    columns = {f"{c}@4h": (c, ind.HOLD_AGG[c]) for c in ("high", "low", "close")}
    held = ind.hold(bars, 60, 240, columns, mode="hold")
    built, names = plan.plan_indicators(["willr", "unknown"], ["15min", "1h", "4h"], 60, {"willr": {"period": [5, 14]}})
    return shown(ind.compute(held, built, keep=KEY).select(*KEY, *names))


def _five(c: str) -> str:
    """All five normalisers of a column over 30 rows."""
    mean, std = _full("avg", c, 30, 15), _full("stddev_samp", c, 30, 15)
    parts = [
        r(f"({c} - ({mean})) / nullif({std}, 0)", f"{c}__zscore"), r(f"{c} - ({mean})", f"{c}__mean_sub"),
        r(f"{c} / nullif({mean}, 0)", f"{c}__mean_div"),
        r(f"CASE WHEN {c}_n >= 15 AND {c} IS NOT NULL THEN ({c}_less + ({c}_same + 1) / 2.0) / {c}_n END", f"{c}__quantiles"),
        r(f"({c} - e_{c}.v) / nullif(e_{c}.v, 0)", f"{c}__ema_norm"),
    ]
    return ", ".join(parts)


@query(
    "normalise_all_features",
    with_ctes(
        B,
        f"x AS (SELECT *, {_full('avg', 'close', 10)} AS sma, (close - {_full('avg', 'close', 10)}) AS gap FROM b)",
        """k AS (SELECT a.ticker, a.pos, count(c.sma) AS sma_n, count(*) FILTER (WHERE c.sma < a.sma) AS sma_less,
          count(*) FILTER (WHERE c.sma = a.sma) AS sma_same, count(c.gap) AS gap_n, count(*) FILTER (WHERE c.gap < a.gap) AS gap_less,
          count(*) FILTER (WHERE c.gap = a.gap) AS gap_same FROM x a JOIN x c ON a.ticker = c.ticker AND c.pos BETWEEN a.pos - 29 AND a.pos GROUP BY 1, 2)""",
        ewm_cte("e_sma", "x", "sma", 2 / 31, 30), ewm_cte("e_gap", "x", "gap", 2 / 31, 30),
        f"""SELECT ticker, ts, {r('sma', 'sma')}, {r('gap', 'gap')}, {_five('sma')}, {_five('gap')}
          FROM x JOIN k USING (ticker, pos) JOIN e_sma USING (ticker, pos) JOIN e_gap USING (ticker, pos)""",
    ),
)
def normalise_all_features(spark, folder):
    """Every normaliser over every feature column."""
    base = ind.compute(event_bars(spark, folder), [ind.smooth("sma", "close", 10, "sma")])
    base = base.withColumn("gap", F.col("close") - F.col("sma"))
    base = base.select(*KEY, "pos", "sma", "gap")
    return shown(ind.normalise(base, ["sma", "gap"], list(ind.NORMALISERS), 30).drop("pos"))


@query("feature_table")
def feature_table(spark, folder):
    """All sixteen indicators on two timeframes, returns, smoothing, z-scores and column choice."""
    out = plan.build_features(
        event_bars(spark, folder),
        60,
        ["15min", "1h", "4h"],
        smooth={"method": "sma", "window": 5},
        normalize={"methods": ["zscore"], "window": 48},
        subset={"exclude": [r"smooth.*zscore"]},
    )
    names = out.columns[3:]
    return shown(plan.drop_sparse(out, names, 0.5).drop("pos"))
