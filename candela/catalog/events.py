"""Event, label and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.catalog.base import B, D, ewmstd_cte, query, r, shown, with_ctes
from candela.operators import events as ev
from candela.operators import labels as lab
from candela.operators import splits
from candela.operators import indicators as ind
from candela.operators.timeline import number
from candela.sources.ticks import event_bars, trade_bars

ALL = "(PARTITION BY ticker ORDER BY pos)"


def lr_cte(name: str = "lr", source: str = "b", x: str = "close") -> str:
    """Log returns with their own numbering."""
    return f"""{name}0 AS (SELECT ticker, ts, pos, ln({x} / lag({x}) OVER {ALL}) AS r FROM {source}),
{name} AS (SELECT ticker, ts, r, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS rn FROM {name}0 WHERE r IS NOT NULL)"""


def sigma_cte(name: str, source: str, lookback: int) -> str:
    w = f"(PARTITION BY ticker ORDER BY rn ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW)"
    return f"""{name} AS (SELECT *, coalesce(CASE WHEN count(r) OVER {w} >= {lookback // 2} THEN stddev_samp(r) OVER {w} END, 0.01)
  AS sigma FROM {source})"""


def cusum_cte(name: str, source: str, limit: str, mode: str = "symmetric", keys: str = "ticker") -> str:
    """One row per return; ``fired`` marks events. Recursion over the return number."""
    k = keys.split(", ")
    cols = ", ".join(f"n.{c}" for c in k)
    on = " AND ".join(f"n.{c} = s.{c}" for c in k)
    up = "sp > lim" if mode in ("symmetric", "positive") else "false"
    dn = "sn < -lim" if mode in ("symmetric", "negative") else "false"
    sp = f"CASE WHEN {up}{' OR ' + dn if mode == 'symmetric' else ''} THEN 0.0 ELSE sp END"
    sn = f"CASE WHEN {dn}{' OR ' + up if mode == 'symmetric' else ''} THEN 0.0 ELSE sn END"
    return f"""{name}_in AS (SELECT {keys}, ts, rn, r, {limit} AS lim FROM {source}),
{name} AS (SELECT {keys}, ts, rn, {sp} AS sp, {sn} AS sn, ({up} OR {dn}) AS fired FROM
    (SELECT {keys}, ts, rn, lim, greatest(0.0, r) AS sp, least(0.0, r) AS sn FROM {name}_in WHERE rn = 1)
  UNION ALL
  SELECT {keys}, ts, rn, {sp}, {sn}, ({up} OR {dn}) FROM
    (SELECT {cols}, n.ts, n.rn, n.lim, greatest(0.0, s.sp + n.r) AS sp, least(0.0, s.sn + n.r) AS sn
     FROM {name} s JOIN {name}_in n ON {on} AND n.rn = s.rn + 1))"""


def _cusum_sql(limit: str, *ctes: str, source: str = "lr", mode: str = "symmetric") -> str:
    return with_ctes(
        B, *ctes, cusum_cte("cu", source, limit, mode), "SELECT ticker, ts FROM cu WHERE fired", recursive=True
    )


def _cusum_query(mode: str):
    @query(f"cusum_{mode}", _cusum_sql("2.05", lr_cte(), mode=mode))
    def run(spark, folder):
        return ev.cusum(event_bars(spark, folder), 2.05, mode)


for _mode in ev.MODES:
    _cusum_query(_mode)


@query("adaptive_cusum", _cusum_sql("1.07 * sigma", lr_cte(), sigma_cte("sg", "lr", 100), source="sg"))
def adaptive_cusum(spark, folder):
    return ev.adaptive_cusum(event_bars(spark, folder), 1.07, 100)


@query("cusum_daily_trades", with_ctes(D, lr_cte("lr", "d"), cusum_cte("cu", "lr", "0.61"), "SELECT ticker, ts FROM cu WHERE fired", recursive=True))
def cusum_daily_trades(spark, folder):
    return ev.cusum(number(trade_bars(spark, folder), step=86_400), 0.61)


_KALMAN = """kf AS (SELECT ticker, ts, pos, close AS x, 1.0::DOUBLE AS p, CAST(NULL AS DOUBLE) AS inn FROM b WHERE pos = 1
  UNION ALL SELECT n.ticker, n.ts, n.pos, k.x + (k.p + 0.01) / (k.p + 0.01 + 1.0) * (n.close - k.x),
    (1 - (k.p + 0.01) / (k.p + 0.01 + 1.0)) * (k.p + 0.01), n.close - k.x
  FROM kf k JOIN b n ON n.ticker = k.ticker AND n.pos = k.pos + 1)"""
_K50 = "(PARTITION BY ticker ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"


@query("kalman_innovations", with_ctes(B, _KALMAN, f"SELECT ticker, ts, {r('inn', 'innovation')} FROM kf", recursive=True))
def kalman_innovations(spark, folder):
    return shown(ev.kalman_innovations(event_bars(spark, folder)).select("ticker", "ts", "innovation"))


@query(
    "kalman_events",
    with_ctes(
        B, _KALMAN,
        f"sp AS (SELECT *, coalesce(CASE WHEN count(inn) OVER {_K50} >= 10 THEN stddev_samp(inn) OVER {_K50} END, 1.0) AS s FROM kf)",
        "SELECT ticker, ts FROM sp WHERE abs(inn) > 2.0 * s",
        recursive=True,
    ),
)
def kalman_events(spark, folder):
    return ev.kalman(event_bars(spark, folder))


def _combined_sql(op: str) -> str:
    return with_ctes(
        B, lr_cte(), sigma_cte("sg", "lr", 100), cusum_cte("cu", "sg", "1.07 * sigma"),
        lr_cte("lv", "b", "volume"), sigma_cte("sv", "lv", 100), cusum_cte("cv", "sv", "0.93 * sigma"),
        f"(SELECT ticker, ts FROM cu WHERE fired {op} SELECT ticker, ts FROM cv WHERE fired)",
        recursive=True,
    )


@query("events_price_or_volume", _combined_sql("UNION"))
def events_price_or_volume(spark, folder):
    return ev.detect(event_bars(spark, folder), k_price=1.07, k_volume=0.93)


@query("events_price_and_volume", _combined_sql("INTERSECT"))
def events_price_and_volume(spark, folder):
    return ev.detect(event_bars(spark, folder), k_price=1.07, k_volume=0.93, combine="intersection")


@query(
    "events_unique_sorted",
    with_ctes(
        B, lr_cte(), cusum_cte("cp", "lr", "2.05", "positive"), cusum_cte("cn", "lr", "2.05", "negative"),
        "SELECT DISTINCT ticker, ts FROM (SELECT ticker, ts FROM cp WHERE fired UNION ALL SELECT ticker, ts FROM cn WHERE fired) ORDER BY 1, 2",
        recursive=True,
    ),
)
def events_unique_sorted(spark, folder):
    bars = event_bars(spark, folder)
    return ev.unique_sorted(ev.cusum(bars, 2.05, "positive").unionByName(ev.cusum(bars, 2.05, "negative")))


@query(
    "event_summary",
    with_ctes(
        B, lr_cte(), cusum_cte("cu", "lr", "2.05"),
        """SELECT b.ticker, count(*) FILTER (WHERE fired) AS n_events, count(*) AS n_bars,
          round(count(*) FILTER (WHERE fired) / count(*), 4) + 0.0 AS event_ratio, min(b.ts) FILTER (WHERE fired) AS first_event,
          max(b.ts) FILTER (WHERE fired) AS last_event, count(*) FILTER (WHERE fired) < 50 AS too_few
          FROM b LEFT JOIN cu ON cu.ticker = b.ticker AND cu.ts = b.ts GROUP BY 1""",
        recursive=True,
    ),
)
def event_summary(spark, folder):
    bars = event_bars(spark, folder)
    return shown(ev.event_summary(bars, ev.cusum(bars, 2.05)), 4)


# ---- labels ------------------------------------------------------------------------------------

_VOL = f"""lrv AS (SELECT ticker, pos, ln(close / lag(close) OVER {ALL}) AS x FROM b),
{ewmstd_cte('vs', 'lrv', 'x', 2 / 101, 50)}"""
_EVENTS = [lr_cte(), cusum_cte("cu", "lr", "2.05"), "e AS (SELECT ticker, ts FROM cu WHERE fired)"]


def _touch_sql(side: str = "1") -> list[str]:
    """Label CTE ``lb`` for events ``e`` with barriers 0.4 / 0.3 sigma, 24 bars ahead."""
    return [
        _VOL,
        f"""st AS (SELECT e.ticker, e.ts, b.pos, b.close AS p0, coalesce(CASE WHEN v > 0 THEN v END, 0.01) AS sg, {side} AS side
          FROM e JOIN b USING (ticker, ts) JOIN vs USING (ticker, pos))""",
        """lv AS (SELECT *, CASE WHEN side >= 0 THEN p0 * (1 + 0.4 * sg) ELSE p0 * (1 - 0.4 * sg) END AS pt,
          CASE WHEN side >= 0 THEN p0 * (1 - 0.3 * sg) ELSE p0 * (1 + 0.3 * sg) END AS sl FROM st)""",
        """fp AS (SELECT lv.ticker, lv.ts, lv.pos, p0, pt, sl, side, max(q.pos) AS i_end,
          min(q.pos) FILTER (WHERE CASE WHEN side >= 0 THEN q.close >= pt ELSE q.close <= pt END) AS i_up,
          min(q.pos) FILTER (WHERE CASE WHEN side >= 0 THEN q.close <= sl ELSE q.close >= sl END) AS i_dn
          FROM lv JOIN b q ON q.ticker = lv.ticker AND q.pos > lv.pos AND q.pos <= lv.pos + 24 GROUP BY ALL)""",
        """pk AS (SELECT *, CASE WHEN i_up IS NOT NULL AND (i_dn IS NULL OR i_up <= i_dn) THEN 'upper' WHEN i_dn IS NOT NULL
          THEN 'lower' ELSE 'vertical' END AS barrier FROM fp)""",
        """ex AS (SELECT pk.*, q.ts AS t1, CASE WHEN side >= 0 THEN (q.close - p0) / p0 ELSE (p0 - q.close) / p0 END AS ret FROM pk
          JOIN b q ON q.ticker = pk.ticker AND q.pos = CASE barrier WHEN 'upper' THEN i_up WHEN 'lower' THEN i_dn ELSE i_end END)""",
        """lb AS (SELECT ticker, ts AS event_ts, t1, ret, CASE barrier WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE
          CASE WHEN ret > 0 THEN 1 ELSE -1 END END AS label, barrier, pt AS pt_level, sl AS sl_level FROM ex)""",
    ]


_LABELS = [*_EVENTS, *_touch_sql()]
_LABEL_COLUMNS = f"""ticker, event_ts, t1, {r('ret', 'ret')}, label::BIGINT AS label, barrier, {r('pt_level', 'pt_level')},
  {r('sl_level', 'sl_level')}"""


def _events(spark, folder):
    bars = number(event_bars(spark, folder))
    return bars, ev.cusum(bars, 2.05)


def _labels(spark, folder):
    bars, events = _events(spark, folder)
    return lab.triple_barrier(events, bars, 0.4, 0.3, 24, vol_span=100)


@query(
    "future_paths",
    with_ctes(
        B, *_EVENTS,
        """SELECT e.ticker, e.ts, count(*) AS path_bars, max(q.close) AS highest, min(q.close) AS lowest FROM e JOIN b USING (ticker, ts)
          JOIN b q ON q.ticker = e.ticker AND q.pos > b.pos AND q.pos <= b.pos + 24 GROUP BY 1, 2""",
        recursive=True,
    ),
)
def future_paths(spark, folder):
    """Range join of events with the bars of their next 24 steps."""
    bars, events = _events(spark, folder)
    at = events.join(bars.select("ticker", "ts", "pos"), ["ticker", "ts"])
    return lab.future_paths(at, bars, 24, 24).groupBy("ticker", "ts").agg(
        F.count(F.lit(1)).alias("path_bars"), F.max("path_close").alias("highest"), F.min("path_close").alias("lowest")
    )


@query(
    "vertical_barriers",
    with_ctes(
        B, *_EVENTS, "n AS (SELECT ticker, max(pos) AS last FROM b GROUP BY 1)",
        """SELECT e.ticker, e.ts AS event_ts, q.ts AS barrier_ts FROM e JOIN b USING (ticker, ts) JOIN n USING (ticker)
          JOIN b q ON q.ticker = e.ticker AND q.pos = least(b.pos + 24, last)""",
        recursive=True,
    ),
)
def vertical_barriers(spark, folder):
    bars, events = _events(spark, folder)
    return lab.vertical_barriers(events, bars, 24)


@query("triple_barrier", with_ctes(B, *_LABELS, f"SELECT {_LABEL_COLUMNS} FROM lb", recursive=True))
def triple_barrier(spark, folder):
    return shown(_labels(spark, folder))


@query(
    "triple_barrier_two_sided",
    with_ctes(
        B, *_EVENTS, *_touch_sql("CASE WHEN b.pos % 2 = 0 THEN 1 ELSE -1 END"), f"SELECT {_LABEL_COLUMNS} FROM lb", recursive=True
    ),
)
def triple_barrier_two_sided(spark, folder):
    """Long and short events: the short side mirrors its barriers."""
    bars, events = _events(spark, folder)
    sided = events.join(bars.select("ticker", "ts", "pos"), ["ticker", "ts"])
    sided = sided.select("ticker", "ts", F.when(F.col("pos") % 2 == 0, 1).otherwise(-1).alias("side"))
    return shown(lab.triple_barrier(sided, bars, 0.4, 0.3, 24, side="side"))


@query(
    "label_weights",
    with_ctes(
        B, *_LABELS,
        f"SELECT ticker, event_ts, {r('least(greatest(abs(ret) / avg(abs(ret)) OVER (PARTITION BY ticker), 0.1), 10.0)', 'weight')} FROM lb",
        recursive=True,
    ),
)
def label_weights(spark, folder):
    return shown(lab.with_weights(_labels(spark, folder)).select("ticker", "event_ts", "weight"))


@query(
    "label_summary",
    with_ctes(
        B, *_LABELS,
        f"""SELECT coalesce(label::BIGINT, 0) AS label, coalesce(barrier, 'all') AS barrier, count(*) AS n, {r('avg(ret)', 'avg_return')}, {r('avg(abs(ret))', 'avg_abs_return')}
          FROM lb GROUP BY GROUPING SETS ((label), (barrier), ())""",
        recursive=True,
    ),
)
def label_summary(spark, folder):
    return shown(lab.label_summary(_labels(spark, folder)).fillna({"label": 0, "barrier": "all"}))


# ---- samples and folds -------------------------------------------------------------------------

_W20 = "(PARTITION BY ticker ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_FEATURES = f"""f0 AS (SELECT ticker, ts, CASE WHEN count(close) OVER {_W20} >= 20 THEN avg(close) OVER {_W20} END AS mean_20,
  CASE WHEN count(volume) OVER {_W20} >= 20 THEN avg(volume) OVER {_W20} END AS volume_20 FROM b)"""
_SAMPLES = "sa AS (SELECT f0.*, lb.* EXCLUDE (ticker, event_ts) FROM f0 JOIN lb ON lb.ticker = f0.ticker AND lb.event_ts = f0.ts)"
_COMPLETE = "sc AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM sa WHERE mean_20 IS NOT NULL AND volume_20 IS NOT NULL)"


def small_features(bars):
    return ind.compute(
        bars,
        [ind.smooth("mean_20", "close", 20, "sma"), ind.smooth("volume_20", "volume", 20, "sma")],
        keep=["ticker", "ts"],
    )


def samples(spark, folder):
    bars, events = _events(spark, folder)
    labels = lab.triple_barrier(events, bars, 0.4, 0.3, 24, vol_span=100)
    return splits.align(small_features(bars), labels), labels


@query(
    "align_features_labels",
    with_ctes(
        B, *_LABELS, _FEATURES, _SAMPLES,
        f"SELECT ticker, ts, {r('mean_20', 'mean_20')}, {r('volume_20', 'volume_20')}, label::BIGINT AS label, t1 FROM sa",
        recursive=True,
    ),
)
def align_features_labels(spark, folder):
    return shown(samples(spark, folder)[0].select("ticker", "ts", "mean_20", "volume_20", "label", "t1"))


@query(
    "complete_samples",
    with_ctes(B, *_LABELS, _FEATURES, _SAMPLES, _COMPLETE, f"SELECT ticker, ts, {r('mean_20', 'mean_20')}, label::BIGINT AS label FROM sc", recursive=True),
)
def complete_samples(spark, folder):
    rows, _ = samples(spark, folder)
    return shown(splits.complete(rows, ["mean_20", "volume_20"]).select("ticker", "ts", "mean_20", "label"))


@query(
    "restrict_labels",
    with_ctes(B, *_LABELS, _FEATURES, _SAMPLES, _COMPLETE, "SELECT ticker, event_ts, barrier FROM lb WHERE (ticker, event_ts) IN (SELECT (ticker, ts) FROM sc)", recursive=True),
)
def restrict_labels(spark, folder):
    rows, labels = samples(spark, folder)
    kept = splits.complete(rows, ["mean_20", "volume_20"])
    return splits.restrict(labels, kept).select("ticker", "event_ts", "barrier")


def fold_ctes(train: str, n_splits: int = 5, test_size: float = 0.15, min_train: int = 30) -> list[str]:
    return [
        f"""fo AS (SELECT DISTINCT ticker, n, k AS fold, greatest(1, floor(n * {test_size})::BIGINT) AS tn,
          n - ({n_splits} - k) * greatest(1, floor(n * {test_size})::BIGINT) AS a FROM sc CROSS JOIN range({n_splits}) t(k))""",
        f"fs AS (SELECT fo.*, sc.ts AS test_start FROM fo JOIN sc ON sc.ticker = fo.ticker AND sc.i = fo.a WHERE a >= {min_train})",
        f"""rl AS (SELECT sc.ticker, sc.ts, fold, CASE WHEN i >= a AND i < a + tn THEN 'test' WHEN {train} THEN 'train' END AS role
          FROM sc JOIN fs USING (ticker))""",
        f"""fd AS (SELECT ticker, ts, fold, role FROM rl WHERE role IS NOT NULL AND (ticker, fold) IN
          (SELECT (ticker, fold) FROM rl WHERE role = 'train' GROUP BY ticker, fold HAVING count(*) >= {min_train}))""",
    ]


_T1 = "sc.ts < test_start AND (t1 IS NULL OR t1 < test_start)"


def folds_of(spark, folder, **options):
    rows, _ = samples(spark, folder)
    rows = splits.complete(rows, ["mean_20", "volume_20"])
    if options.pop("without_t1", False):
        rows = rows.drop("t1")
    return splits.walk_forward(rows, 5, 0.15, 30, **options)


@query("walk_forward_folds", with_ctes(B, *_LABELS, _FEATURES, _SAMPLES, _COMPLETE, *fold_ctes(_T1), "SELECT * FROM fd", recursive=True))
def walk_forward_folds(spark, folder):
    return folds_of(spark, folder).withColumn("fold", F.col("fold").cast("long"))


@query(
    "walk_forward_folds_fixed_purge",
    with_ctes(B, *_LABELS, _FEATURES, _SAMPLES, _COMPLETE, *fold_ctes("sc.ts < test_start - INTERVAL 24 HOUR"), "SELECT * FROM fd", recursive=True),
)
def walk_forward_folds_fixed_purge(spark, folder):
    return folds_of(spark, folder, without_t1=True).withColumn("fold", F.col("fold").cast("long"))


@query(
    "walk_forward_folds_rolling",
    with_ctes(B, *_LABELS, _FEATURES, _SAMPLES, _COMPLETE, *fold_ctes(_T1 + " AND i >= a - 60"), "SELECT * FROM fd", recursive=True),
)
def walk_forward_folds_rolling(spark, folder):
    return folds_of(spark, folder, width=60).withColumn("fold", F.col("fold").cast("long"))


@query(
    "fold_summary",
    with_ctes(
        B, *_LABELS, _FEATURES, _SAMPLES, _COMPLETE, *fold_ctes(_T1),
        "SELECT ticker, fold, role, count(*) AS n, min(ts) AS starts, max(ts) AS ends FROM fd GROUP BY 1, 2, 3",
        recursive=True,
    ),
)
def fold_summary(spark, folder):
    return splits.fold_summary(folds_of(spark, folder)).withColumn("fold", F.col("fold").cast("long"))


@query(
    "purge_and_embargo_dates",
    with_ctes(
        B, *_LABELS, _FEATURES, _SAMPLES, _COMPLETE, *fold_ctes(_T1),
        """bd AS (SELECT ticker, fold, max(ts) FILTER (WHERE role = 'train') AS train_end, min(ts) FILTER (WHERE role = 'test') AS test_start,
          max(ts) FILTER (WHERE role = 'test') AS test_end, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM fd GROUP BY 1, 2)""",
        """SELECT ticker, fold, least(train_end, test_start - INTERVAL 24 HOUR) AS train_end,
          make_timestamp(epoch_us(test_end) + round(span * 0.01)::BIGINT) AS embargo_end FROM bd""",
        recursive=True,
    ),
)
def purge_and_embargo_dates(spark, folder):
    bounds = folds_of(spark, folder).groupBy("ticker", "fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("ts"))).alias("train_end"),
        F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("test_start"),
        F.max(F.when(F.col("role") == "test", F.col("ts"))).alias("test_end"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span"),
    )
    return bounds.select(
        "ticker",
        F.col("fold").cast("long").alias("fold"),
        splits.purged_train_end(F.col("train_end"), F.col("test_start"), 24).alias("train_end"),
        splits.embargo_end(F.col("test_end"), F.col("span"), 0.01).alias("embargo_end"),
    )
