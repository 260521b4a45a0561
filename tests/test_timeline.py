"""Blocks far smaller than a series must give the result of one walk over the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from series import by_ticker, cusum, make_bars, supertrend

from candela.operators import events as ev
from candela.operators import indicators as ind
from candela.operators.timeline import Carry, bounded, fold, number, running

BLOCK = 16


def collected(df):
    return df.toPandas().sort_values(["ticker", "ts"]).reset_index(drop=True)


def test_number_with_many_slices(spark):
    pdf, bars = make_bars(spark)
    got = collected(number(bars, block=7))
    want = by_ticker(pdf, lambda g: g.assign(pos=np.arange(1, len(g) + 1)))
    assert (got.pos.to_numpy() == want.pos.to_numpy()).all()


def test_bounded_window_across_blocks(spark):
    pdf, bars = make_bars(spark)
    stage = lambda f: {"m": f.full(F.avg("close"), F.col("close"), 10), "n": f.lead("close", 2)}
    got = collected(bounded(number(bars), [stage], back=9, ahead=2, block=BLOCK))
    want = by_ticker(pdf, lambda g: g.assign(m=g.close.rolling(10).mean(), n=g.close.shift(-2)))
    assert len(got) == len(want)
    np.testing.assert_allclose(got.m, want.m, rtol=1e-12)
    np.testing.assert_allclose(got.n, want.n)


@pytest.mark.parametrize("backward", [False, True])
def test_running_values(spark, backward):
    pdf, _ = make_bars(spark)
    pdf["x"] = pdf.close.where(pdf.index % 5 == 2)
    bars = spark.createDataFrame(pdf)
    x = F.when(~F.isnan("x"), F.col("x"))
    kinds = {k: (k, x) for k in ("sum", "max", "min", "last", "first")}
    got = collected(running(number(bars), kinds, block=BLOCK, backward=backward))

    def one(g):
        s = g.x[::-1] if backward else g.x
        out = pd.DataFrame(
            {"sum": s.cumsum().ffill(), "max": s.cummax().ffill(), "min": s.cummin().ffill(), "last": s.ffill()}
        )
        valid = s.dropna()
        out["first"] = np.where(out["last"].notna(), valid.iloc[0] if len(valid) else np.nan, np.nan)
        return out.sort_index()

    want = by_ticker(pdf, one)
    for k in kinds:
        np.testing.assert_allclose(got[k].astype(float), want[k], rtol=1e-12, err_msg=k)


def test_ewm_matches_pandas_with_gaps():
    rng = np.random.default_rng(0)
    x = rng.normal(50, 5, 2000)
    x[:7] = np.nan
    x[100:130] = np.nan
    for alpha, std in [(2 / 21, False), (2 / 21, True), (1 / 14, False), (0.5, True), (2 / 101, True), (1.0, False)]:
        e = pd.Series(x).ewm(alpha=alpha, min_periods=10)
        want = (e.std() if std else e.mean()).to_numpy()
        state, parts = None, []
        for lo in range(0, len(x), 333):
            carry = Carry(state)
            parts.append(carry.ewm(x[lo : lo + 333], alpha, 10, std))
            state = carry.out
        # After a long gap pandas and we both lose digits in W*W - sum(w*w).
        np.testing.assert_allclose(np.concatenate(parts), want, rtol=1e-6)


def test_fold_hands_state_over_when_guesses_are_wrong(spark):
    """A plain counter never forgets, so every guess but the first is wrong and must be put right."""
    _, bars = make_bars(spark, lengths=(70, 5))

    def step(k, x):
        (total,) = k.take([0.0])
        out = total + np.cumsum(x["one"])
        k.give(out[-1])
        return {"count": out}

    df = number(bars).withColumn("one", F.lit(1.0))
    got = collected(fold(df, step, {"count": "double"}, ["one"], warmup=3, block=BLOCK))
    assert (got["count"] == got.pos).all()


@pytest.mark.parametrize("mode", ev.MODES)
def test_cusum_blocks(spark, mode):
    pdf, bars = make_bars(spark)
    got = collected(ev.cusum(bars, 0.05, mode, block=BLOCK))
    want = by_ticker(
        pdf,
        lambda g: g.iloc[1:][cusum(np.log(g.close / g.close.shift(1)).iloc[1:], [0.05] * (len(g) - 1), mode)],
    )
    assert list(zip(got.ticker, got.ts)) == list(zip(want.ticker, want.ts))


def test_adaptive_cusum_blocks(spark):
    pdf, bars = make_bars(spark)
    got = collected(ev.adaptive_cusum(bars, 1.1, 20, block=BLOCK))

    def one(g):
        r = np.log(g.close / g.close.shift(1)).iloc[1:]
        sigma = r.rolling(20, min_periods=10).std().fillna(0.01)
        return g.iloc[1:][cusum(r, 1.1 * sigma, "symmetric")]

    want = by_ticker(pdf, one)
    assert list(zip(got.ticker, got.ts)) == list(zip(want.ticker, want.ts))


def test_indicators_in_blocks(spark):
    pdf, bars = make_bars(spark, flat=[(40, 60)])
    got = collected(
        ind.compute(
            bars,
            [
                ind.supertrend("st", 5, 1.5),
                ind.ema("e", 6),
                ind.rsi("r", 5),
                ind.ew_volatility("v", 10),
                ind.obv("o"),
                ind.vwap("w"),
                ind.ofi("f", 5),
                ind.quantile_rank("q", "close", 12),
                ind.tick_autocorr("a", 6),
            ],
            block=BLOCK,
        )
    )

    def one(g):
        change = g.close.diff()
        lr = np.log(g.close / g.close.shift(1))
        gain = change.clip(lower=0).ewm(alpha=1 / 5, min_periods=5).mean()
        loss = (-change).clip(lower=0).ewm(alpha=1 / 5, min_periods=5).mean()
        side = np.sign(change).replace(0, np.nan).ffill().fillna(0)
        buy = (g.volume * (side == 1)).rolling(5, min_periods=1).sum()
        sell = (g.volume * (side == -1)).rolling(5, min_periods=1).sum()
        tp = (g.high + g.low + g.close) / 3
        return pd.DataFrame(
            {
                "st": supertrend(g, 5, 1.5),
                "e": g.close.ewm(span=6, min_periods=6).mean(),
                "r": 100 - 100 / (1 + gain / loss.replace(0, np.nan)),
                "v": lr.ewm(span=10, min_periods=5).std(),
                "o": (g.volume * np.sign(change).fillna(0)).cumsum(),
                "w": (tp * g.volume).cumsum() / g.volume.cumsum(),
                "f": (buy - sell) / (buy + sell).replace(0, np.nan),
                "q": g.close.rolling(12, min_periods=6).apply(lambda x: pd.Series(x).rank(pct=True).iloc[-1]),
                "a": g.close.pct_change().rolling(6).apply(
                    lambda x: pd.Series(x).autocorr(1) if x.nunique() > 2 else np.nan, raw=False
                ),
            }
        )

    want = by_ticker(pdf, one)
    for c in want.columns:
        if c == "a":  # windows touching the flat stretch have no defined correlation
            both = want[c].notna() & got[c].notna()
            assert both.sum() > 200
            np.testing.assert_allclose(got[c][both], want[c][both], atol=1e-9, err_msg=c)
        else:
            np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-9, err_msg=c)
