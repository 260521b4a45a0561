"""Hand-made paths for the triple barrier, and folds in small blocks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import make_bars

from candela.operators import cleaning, labels, splits
from candela.operators.timeline import number

HOUR = pd.Timedelta(hours=1)
T0 = pd.Timestamp("2024-01-01")


def bars_of(spark, closes, ticker="x"):
    rows = [(ticker, (T0 + i * HOUR).to_pydatetime(), c, c, c, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double")


def label_of(spark, closes, pt=1.0, sl=1.0, ahead=5, side=1, at=0):
    """Fallback volatility is 0.01, so a multiplier of 5 is 5 percent."""
    bars = bars_of(spark, closes)
    event = spark.createDataFrame([("x", (T0 + at * HOUR).to_pydatetime(), side)], "ticker string, ts timestamp, side int")
    return labels.triple_barrier(event, bars, pt, sl, ahead, side="side").collect()


@pytest.mark.parametrize(
    "closes, options, barrier, label",
    [
        ([100, 101, 106, 90], {}, "upper", 1),
        ([100, 99, 94, 120], {}, "lower", -1),
        ([100, 101, 102, 103], {}, "vertical", 1),
        ([100, 101, 102, 100], {}, "vertical", -1),  # no change counts as a fall
        ([100, 101, 102, 99, 106], {"ahead": 3}, "vertical", -1),
        ([100, 106, 94], {"side": -1}, "lower", -1),
        ([100, 94, 106], {"side": -1}, "upper", 1),
        ([100, 150, 50], {"pt": 0.0}, "lower", -1),
        ([100, 50, 150], {"sl": 0.0}, "upper", 1),
        ([100, 105], {}, "upper", 1),  # touching is enough
    ],
)
def test_first_touch(spark, closes, options, barrier, label):
    (row,) = label_of(spark, [float(c) for c in closes], **({"pt": 5.0, "sl": 5.0} | options))
    assert (row["barrier"], row["label"]) == (barrier, label)


def test_event_on_last_bar_is_dropped(spark):
    assert label_of(spark, [100.0, 101.0, 102.0], at=2) == []


def test_path_join_reaches_across_stretches(spark):
    pdf, bars = make_bars(spark, lengths=(150,), gaps=False)
    numbered = number(bars)
    for horizon in (1, 3, 7):
        got = labels.future_paths(numbered.select("ticker", "ts", "pos"), numbered, horizon, horizon)
        counts = got.groupBy("pos").agg(F.count("*").alias("n"), F.min("path_pos").alias("lo"), F.max("path_pos").alias("hi"))
        rows = counts.collect()
        assert len(rows) == 149
        for r in rows:
            assert (r["lo"], r["hi"], r["n"]) == (r["pos"] + 1, min(r["pos"] + horizon, 150), min(horizon, 150 - r["pos"]))


def test_folds_never_train_on_labels_that_reach_the_test(spark):
    _, bars = make_bars(spark, lengths=(200, 60))
    rows = number(bars).select("ticker", "ts", (F.col("ts") + F.expr("INTERVAL 5 HOURS")).alias("t1"))
    folds = splits.walk_forward(rows, 4, 0.15, 20).join(rows, ["ticker", "ts"]).toPandas()
    assert set(folds.role) == {"train", "test"}
    for _, g in folds.groupby(["ticker", "fold"]):
        train, test = g[g.role == "train"], g[g.role == "test"]
        assert train.t1.max() < test.ts.min()
        assert not set(train.ts) & set(test.ts)
        assert len(train) >= 20


def test_a_label_ending_when_the_test_starts_is_purged(spark):
    _, bars = make_bars(spark, lengths=(40,), gaps=False)
    rows = number(bars).select("ticker", "ts", (F.col("ts") + F.expr("INTERVAL 1 HOURS")).alias("t1"))
    folds = splits.walk_forward(rows, 1, 0.25, 5).toPandas()
    assert (folds.role == "test").sum() == 10 and (folds.role == "train").sum() == 29


def test_fill_in_small_blocks(spark):
    pdf, _ = make_bars(spark, lengths=(75, 8))
    pdf["x"] = pdf.close.where((pdf.index % 7 == 3) & (pdf.index < 78))
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    got = cleaning.fill(df, ["x"], block=8).toPandas().sort_values(["ticker", "ts"])
    want = pd.concat([g.x.ffill().bfill() for _, g in pdf.groupby("ticker")])
    assert (got.x.fillna(-1).to_numpy() == want.fillna(-1).to_numpy()).all()


def test_constant_series_has_no_division_error(spark):
    from candela.operators import indicators as ind

    bars = bars_of(spark, [10.0] * 30).withColumn("volume", F.lit(0.0))
    every = [
        ind.willr("a", 5), ind.cmf("b", 5), ind.cci("c", 5), ind.rsi("d", 5), ind.mfi("e", 5), ind.ofi("f", 5), ind.vwap("g"),
        ind.trans_rate("h", 5), ind.tick_autocorr("i", 5), ind.zscore("j", "close", 6), ind.adx("k", 3), ind.returns("l", 2),
    ]
    row = ind.compute(bars, every).orderBy(F.desc("ts")).first()
    assert all(row[c] is None for c in "abcdefghijk")
    assert row["l_return"] == 0.0
