"""Source, clean-up, filter and check queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from candela.catalog.base import B, D, query, r, shown, with_ctes
from candela.functions.scalars import ranges_overlap, safe_div
from candela.operators import cleaning
from candela.operators import indicators as ind
from candela.operators.timeline import number
from candela.plans import features as plan
from candela.sources import files, store
from candela.session import shared_folder
from candela.sources.ticks import event_bars, trade_bars

ALL = "(PARTITION BY ticker ORDER BY pos)"
OHLCV = "ticker, ts, open, high, low, close, volume"
START, END, CUTOFF = datetime(2024, 1, 5), datetime(2024, 1, 20), datetime(2024, 1, 21)


def scratch(spark, name: str) -> str:
    """A new folder for files a query writes and reads back."""
    return f"{shared_folder(spark)}/candela-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("bars_hourly_from_events", with_ctes(B, f"SELECT {OHLCV} FROM b"))
def bars_hourly_from_events(spark, folder):
    return event_bars(spark, folder)


@query(
    "bars_4h_from_events",
    """SELECT event_type AS ticker, make_timestamp((epoch_us(ts) // 14400000000) * 14400000000) AS ts, arg_min(value, ts) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, round(sum(value), 2) AS volume FROM events GROUP BY 1, 2""",
)
def bars_4h_from_events(spark, folder):
    return event_bars(spark, folder, 14_400)


@query("bars_daily_from_trades", with_ctes(D, f"SELECT {OHLCV} FROM d"))
def bars_daily_from_trades(spark, folder):
    return trade_bars(spark, folder)


@query("read_ohlcv_csv", with_ctes(B, f"SELECT 'all_' || ticker AS ticker, ts, open, high, low, close, volume FROM b WHERE ticker = 'click'"))
def read_ohlcv_csv(spark, folder):
    """Bars written as CSV with other spellings of the column names, read back as one series."""
    path = scratch(spark, "csv")
    bars = event_bars(spark, folder).filter("ticker = 'click'")
    out = bars.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" Datetime"), F.col("open").alias("OPEN"), F.col("high").alias("High"),
        F.col("low").alias("Low "), F.col("close").alias("Last"), F.col("volume").alias("VOLUME"), F.lit("x").alias("note"),
    )
    out.write.mode("overwrite").option("header", True).csv(path)
    return files.read_ohlcv(spark, path, "all_click", rename={"Last": "close"})


@query("normalise_columns", with_ctes(B, "SELECT ticker, ts, close * 0.5 AS open, high, close * 0.5 AS low, close * 0.5 AS close, 0.0::DOUBLE AS volume FROM b"))
def normalise_columns(spark, folder):
    """Adjusted close wins over close; missing open, low and volume are filled in."""
    bars = event_bars(spark, folder)
    return cleaning.normalise_ohlcv(bars.select("ticker", "ts", "high", "close", (F.col("close") * 0.5).alias("Adj Close")))


@query("period_inclusive", with_ctes(B, f"SELECT {OHLCV} FROM b WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'"))
def period_inclusive(spark, folder):
    return cleaning.between(event_bars(spark, folder), START, END)


@query(
    "result_files_round_trip",
    with_ctes(
        D,
        f"SELECT ticker AS profile, ts::DATE AS date, close AS portfolio_value, open AS benchmark_value, 'neutral' AS regime FROM d",
    ),
)
def result_files_round_trip(spark, folder):
    """Daily results to JSON by profile and back."""
    path = scratch(spark, "results")
    bars = trade_bars(spark, folder)
    files.write_results(
        bars.select(
            F.col("ticker").alias("profile"), F.to_date("ts").alias("date"), F.col("close").alias("portfolio_value"),
            F.col("open").alias("benchmark_value"), F.create_map(F.col("ticker"), F.lit(1.0)).alias("allocations"),
            F.lit(0.5).alias("confidence"), F.lit("neutral").alias("regime"), F.lit("Kelly").alias("optimizer"),
        ),
        path,
    )
    return files.read_results(spark, path).select("profile", "date", "portfolio_value", "benchmark_value", "regime")


@query(
    "stored_features_reused",
    with_ctes(B, f"SELECT ticker, ts, {r('CASE WHEN pos >= 20 THEN avg(close) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END', 'mean_20')} FROM b"),
)
def stored_features_reused(spark, folder):
    """Features and events stored under their configuration and read back for unchanged series."""
    path = scratch(spark, "stage")
    config = {"mean": 20}
    bars = number(event_bars(spark, folder))
    features = ind.compute(bars, [ind.smooth("mean_20", "close", 20, "sma")], keep=["ticker", "ts"])
    store.save_stage(path, config, bars, features, bars.select("ticker", "ts").filter("pos % 10 = 0"))
    loaded, _, _ = store.load_stage(spark, path, config, bars)
    return shown(loaded.select("ticker", "ts", "mean_20"))


# ---- columns and rows --------------------------------------------------------------------------


@query("choose_columns", with_ctes(B, "SELECT ticker, ts, high, close FROM b"))
def choose_columns(spark, folder):
    bars = event_bars(spark, folder)
    names = plan.choose_names(["open", "high", "low", "close", "volume"], include=["^h", "o"], exclude=["^o", "^l", "vol"])
    return bars.select("ticker", "ts", *names)


_GAPPY = f"""gp AS (SELECT *, CASE WHEN pos > 30 AND pos % 4 <> 0 THEN close END AS a, CASE WHEN pos > 10 AND pos % 9 <> 0 THEN open END AS c,
  CASE WHEN pos % 3 = 0 THEN high END AS e FROM b)"""


def gappy(spark, folder):
    p = F.col("pos")
    return number(event_bars(spark, folder)).withColumns(
        {
            "a": F.when((p > 30) & (p % 4 != 0), F.col("close")),
            "c": F.when((p > 10) & (p % 9 != 0), F.col("open")),
            "e": F.when(p % 3 == 0, F.col("high")),
        }
    )


@query(
    "missing_shares",
    with_ctes(
        B, _GAPPY,
        f"""SELECT 'a' AS "column", {r('avg((a IS NULL)::INT)', 'missing_share')} FROM gp UNION ALL
        SELECT 'c', round(avg((c IS NULL)::INT), 6) + 0.0 FROM gp UNION ALL SELECT 'e', round(avg((e IS NULL)::INT), 6) + 0.0 FROM gp""",
    ),
)
def missing_shares(spark, folder):
    return shown(plan.missing_share(gappy(spark, folder), ["a", "c", "e"]))


@query("fullest_columns", with_ctes(B, _GAPPY, "SELECT ticker, ts, a, c FROM gp"))
def fullest_columns(spark, folder):
    return plan.fullest(gappy(spark, folder).select("ticker", "ts", "a", "c", "e"), ["a", "c", "e"], 2)


@query("drop_sparse_columns", with_ctes(B, _GAPPY, "SELECT ticker, ts, a, c FROM gp"))
def drop_sparse_columns(spark, folder):
    return plan.drop_sparse(gappy(spark, folder).select("ticker", "ts", "a", "c", "e"), ["a", "c", "e"], 0.5)


@query("infinite_to_missing", with_ctes(B, f"SELECT ticker, ts, {r('volume / nullif(high - low, 0)', 'ratio')} FROM b"))
def infinite_to_missing(spark, folder):
    span = F.col("high") - F.col("low")
    bars = event_bars(spark, folder).withColumn(
        "ratio", F.when(span == 0, F.lit(float("inf"))).otherwise(F.col("volume") / F.nullif(span, F.lit(0.0)))
    )
    return shown(cleaning.drop_infinite(bars, ["ratio"]).select("ticker", "ts", "ratio"))


@query("training_and_scoring_cut", with_ctes(B, "SELECT ticker, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-21') AS train, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-21') AS score FROM b GROUP BY 1"))
def training_and_scoring_cut(spark, folder):
    bars = event_bars(spark, folder)
    n = lambda df, name: df.groupBy("ticker").agg(F.count(F.lit(1)).alias(name))
    return n(cleaning.before(bars, CUTOFF), "train").join(n(cleaning.since(bars, CUTOFF), "score"), "ticker")


@query("rows_with_all_features", with_ctes(B, _GAPPY, "SELECT ticker, ts, a, c FROM gp WHERE a IS NOT NULL AND c IS NOT NULL"))
def rows_with_all_features(spark, folder):
    return gappy(spark, folder).select("ticker", "ts", "a", "c").dropna("any", subset=["a", "c"])


_SIGNALS = "sg AS (SELECT ts, ticker, CASE WHEN close > open THEN 1 ELSE -1 END AS signal FROM b)"


@query(
    "long_only_universe",
    with_ctes(B, _SIGNALS, "SELECT ts, ticker, signal::BIGINT AS signal FROM (SELECT *, max(signal) OVER (PARTITION BY ts) AS top FROM sg) WHERE top = -1 OR signal = 1"),
)
def long_only_universe(spark, folder):
    signals = event_bars(spark, folder).select("ts", "ticker", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("signal"))
    return shown(cleaning.long_only(signals, ["ts"]))


@query("minimum_history", with_ctes(D, f"SELECT ticker, ts, close FROM d WHERE ticker IN (SELECT ticker FROM d GROUP BY 1 HAVING count(*) >= 2499)"))
def minimum_history(spark, folder):
    return cleaning.with_history(trade_bars(spark, folder), 2_499).select("ticker", "ts", "close")


@query(
    "clip_outliers",
    with_ctes(D, "s AS (SELECT ticker, avg(close) AS m, stddev_samp(close) AS s FROM d GROUP BY 1)", f"SELECT ticker, ts, {r('least(greatest(close, m - 1.5 * s), m + 1.5 * s)', 'close', 8)} FROM d JOIN s USING (ticker)"),
)
def clip_outliers(spark, folder):
    return shown(cleaning.clip_outliers(trade_bars(spark, folder), "close", 1.5).select("ticker", "ts", "close"), 8)


@query("safe_division", with_ctes(B, f"SELECT ticker, ts, {r('coalesce(volume / nullif(high - low, 0), -1)', 'ratio')} FROM b"))
def safe_division(spark, folder):
    bars = event_bars(spark, folder)
    return shown(bars.select("ticker", "ts", safe_div("volume", F.col("high") - F.col("low"), -1.0).alias("ratio")))


@query(
    "fill_missing",
    with_ctes(
        B, _GAPPY,
        f"""SELECT ticker, ts, coalesce(last_value(a IGNORE NULLS) OVER {ALL}, first_value(a IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS a, coalesce(last_value(c IGNORE NULLS) OVER {ALL},
          first_value(c IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS c FROM gp""",
    ),
)
def fill_missing(spark, folder):
    return cleaning.fill(gappy(spark, folder), ["a", "c"]).select("ticker", "ts", "a", "c")


@query("fill_forward_then_zero", with_ctes(B, _GAPPY, f"SELECT ticker, ts, coalesce(last_value(a IGNORE NULLS) OVER {ALL}, 0) AS a FROM gp"))
def fill_forward_then_zero(spark, folder):
    return cleaning.fill(gappy(spark, folder), ["a"], backward=False, default=0.0).select("ticker", "ts", "a")


@query("leading_missing", with_ctes(B, _GAPPY, "SELECT ticker, min(pos) FILTER (WHERE a IS NOT NULL) - 1 AS leading_missing FROM gp GROUP BY 1"))
def leading_missing(spark, folder):
    return cleaning.leading_missing(gappy(spark, folder), "a")


@query(
    "price_checks",
    with_ctes(B, _GAPPY, """SELECT 'missing prices' AS rule, count(*) AS rows, count(*) FILTER (WHERE a IS NULL) + count(*) FILTER (WHERE c IS NULL) AS nulls FROM gp
      HAVING count(*) FILTER (WHERE a IS NULL) + count(*) FILTER (WHERE c IS NULL) > 0"""),
)
def price_checks(spark, folder):
    return cleaning.check_prices(gappy(spark, folder), ["a", "c"])


@query(
    "weight_checks",
    with_ctes(
        B,
        """wg AS (SELECT ts, ticker, (close - 2) / sum(CASE WHEN ticker = 'click' AND pos % 5 = 0 THEN close ELSE close - 2 END) OVER (PARTITION BY ts) AS weight FROM b)""",
        f"SELECT ts, {r('sum(weight)', 'total')}, {r('min(weight)', 'least')} FROM wg GROUP BY 1 HAVING abs(sum(weight) - 1) > 1e-5 OR min(weight) < -1e-5",
    ),
)
def weight_checks(spark, folder):
    bars = number(event_bars(spark, folder))
    part = F.when((F.col("ticker") == "click") & (F.col("pos") % 5 == 0), F.col("close")).otherwise(F.col("close") - 2)
    total = bars.groupBy("ts").agg(F.sum(part).alias("_total"))
    weights = bars.join(total, "ts").select("ts", "ticker", F.try_divide(F.col("close") - 2, "_total").alias("weight"))
    return shown(cleaning.check_weights(weights, ["ts"]))


@query(
    "bar_frequency",
    with_ctes(
        B,
        f"g AS (SELECT ticker, (epoch(ts) - epoch(lag(ts) OVER {ALL})) / 60 AS m FROM b)",
        "c AS (SELECT ticker, m, count(*) AS n FROM g WHERE m IS NOT NULL GROUP BY 1, 2)",
        "mo AS (SELECT ticker, arg_max(m, n * 1e9 - m) AS m FROM c GROUP BY 1)",
        "md AS (SELECT ticker, median(m) AS d FROM g WHERE m IS NOT NULL GROUP BY 1)",
        """SELECT ticker, floor(m)::BIGINT AS minutes, CASE WHEN d <= 5 THEN '5m' WHEN d <= 15 THEN '15m' WHEN d <= 60 THEN '1h' WHEN d <= 240 THEN '4h'
          ELSE '1d' END AS size FROM mo JOIN md USING (ticker)""",
    ),
)
def bar_frequency(spark, folder):
    return cleaning.bar_frequency(event_bars(spark, folder))


@query("lookback_tail", with_ctes(D, f"SELECT ticker, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS k FROM d) WHERE k <= 225"))
def lookback_tail(spark, folder):
    return cleaning.lookback(number(trade_bars(spark, folder), step=86_400), 225).select("ticker", "ts", "close")


@query(
    "date_ranges_overlap",
    with_ctes(
        B,
        "rg AS (SELECT ticker, floor((pos - 1) / 200)::BIGINT AS part, min(ts) AS s, max(ts) + INTERVAL 2 HOUR AS e FROM b GROUP BY 1, 2)",
        "SELECT x.ticker, x.part AS part, y.part AS other, x.s <= y.e AND y.s <= x.e AS overlap FROM rg x JOIN rg y ON x.ticker = y.ticker AND y.part = x.part + 1",
    ),
)
def date_ranges_overlap(spark, folder):
    part = F.floor((F.col("pos") - 1) / F.lit(200)).cast("long")
    ranges = number(event_bars(spark, folder)).groupBy("ticker", part.alias("part")).agg(
        F.min("ts").alias("s"), (F.max("ts") + F.expr("INTERVAL 2 HOURS")).alias("e")
    )
    after = ranges.select("ticker", (F.col("part") - 1).alias("part"), F.col("part").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return ranges.join(after, ["ticker", "part"]).select("ticker", "part", "other", ranges_overlap("s", "e", "s2", "e2").alias("overlap"))


@query(
    "parameter_product",
    with_ctes(
        B,
        f"""SELECT ticker, period, mult, count(*) FILTER (WHERE high > close * mult) AS n, {r('avg(close) FILTER (WHERE pos % period = 0)', 'mean_close')}
        FROM b CROSS JOIN (VALUES (5), (10), (20)) p(period) CROSS JOIN (VALUES (1.5::DOUBLE), (2.5::DOUBLE)) q(mult) GROUP BY 1, 2, 3""",
    ),
)
def parameter_product(spark, folder):
    """Every bar under every parameter combination."""
    bars = plan.with_parameters(number(event_bars(spark, folder)), {"period": [5, 10, 20], "mult": [1.5, 2.5]})
    return shown(
        bars.groupBy("ticker", "period", "mult").agg(
            F.count_if(F.col("high") > F.col("close") * F.col("mult")).alias("n"),
            F.avg(F.when(F.col("pos") % F.col("period") == 0, F.col("close"))).alias("mean_close"),
        )
    )
