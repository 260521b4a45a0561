"""Weights against plain numpy statements, accounting against a day loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import metrics, panel, portfolio, trailing
from candela.plans import backtest


def test_mean_variance_beats_every_grid_point():
    rng = np.random.default_rng(1)
    for penalty in (0.0, 0.001, 0.05):
        a = rng.normal(size=(3, 3))
        cov, mu, old = a @ a.T * 0.01, rng.normal(0, 0.01, 3), np.array([0.2, 0.5, 0.3])
        cost = lambda w: 1.5 * w @ cov @ w - mu @ w + penalty * np.abs(w - old).sum()
        w = portfolio.mean_variance_vector(mu, cov, old, 3.0, penalty)
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-9
        grid = [np.array([i, j, 100 - i - j]) / 100 for i in range(101) for j in range(101 - i)]
        assert cost(w) <= min(cost(g) for g in grid) + 1e-9


def cap_by_rounds(raw, cap):
    """What exceeds the cap moves in equal parts to the others, for 200 rounds."""
    w = np.maximum(raw, 0.0)
    if w.sum() <= 0:
        return np.full(len(w), 1.0 / len(w))
    w = w / w.sum()
    for _ in range(200):
        high = w > cap
        if high.any():
            spare = (w[high] - cap).sum() / max(1, (~high).sum()) * (not high.all())
            w = np.where(high, cap, w + spare)
    return w / w.sum()


def test_cap_on_columns_equals_cap_by_rounds(spark):
    rng = np.random.default_rng(2)
    cases = [rng.normal(size=4) for _ in range(20)] + [np.array([-1.0, -2.0, -3.0, 0.0]), np.array([9.0, 1.0, 0.0, 0.0])]
    cases += [np.array([0.7, 0.3]), np.array([1.0]), np.array([0.9, 0.05, 0.05])]
    rows = [(i, f"t{k}", float(x)) for i, case in enumerate(cases) for k, x in enumerate(case)]
    got = portfolio.cap_weights(spark.createDataFrame(rows, "g int, ticker string, weight double"), ["g"], 0.4).toPandas()
    for i, case in enumerate(cases):
        w = got[got.g == i].sort_values("ticker").weight.to_numpy()
        np.testing.assert_allclose(w, cap_by_rounds(case, 0.4), atol=1e-9)
        assert abs(w.sum() - 1) < 1e-12 and (w.max() <= 0.4 + 1e-9 or (case <= 0).all() or len(case) < 3)


def test_merge_order_keeps_close_tickers_together():
    d = np.array([[0, 0.9, 0.1, 0.8], [0.9, 0, 0.7, 0.2], [0.1, 0.7, 0, 0.95], [0.8, 0.2, 0.95, 0]])
    for method in ("single", "complete", "average"):
        assert portfolio.merge_order(d, method) == [0, 2, 1, 3]


def test_black_litterman_leans_towards_the_view():
    cov = np.diag([0.0004, 0.0004, 0.0004])
    even = portfolio.black_litterman_vector(cov, np.zeros(3), 0.7)
    np.testing.assert_allclose(even / even.sum(), 1 / 3, atol=1e-9)
    tilted = portfolio.black_litterman_vector(cov, np.array([1.0, 0.0, -1.0]), 0.7)
    assert tilted[0] > tilted[1] > tilted[2]


def test_black_litterman_equals_the_two_inverse_form():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(5, 5)) * 0.01
    cov, strength = a @ a.T, np.array([0.4, np.nan, -0.2, 0.9, np.nan])
    sigma, seen = cov * 252 + np.eye(5) * 1e-6, [0, 2, 3]
    pick = np.eye(5)[seen]
    doubt = np.diag(0.3 / 0.7 * 0.05 * np.diag(sigma)[seen] + 1e-8)
    precision = np.linalg.inv(0.05 * sigma)
    posterior = np.linalg.inv(precision + pick.T @ np.linalg.inv(doubt) @ pick)
    view = strength[seen] * np.sqrt(np.diag(sigma)[seen] / 252)
    mean = posterior @ (precision @ (2.5 * sigma @ np.full(5, 0.2)) + pick.T @ np.linalg.inv(doubt) @ view)
    want = np.linalg.solve(2.5 * (sigma + posterior), mean)
    np.testing.assert_allclose(portfolio.black_litterman_vector(cov, strength, 0.7), want, rtol=1e-6)


def test_parity_shares_against_cluster_variance():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(6, 6))
    cov, order = a @ a.T, [3, 0, 5, 1, 4, 2]

    def variance(part):
        inverse = 1 / np.diag(cov)[part]
        return inverse @ cov[np.ix_(part, part)] @ inverse / inverse.sum() ** 2

    want = np.ones(6)

    def share(part):
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = variance(left), variance(right)
            want[left] *= b / (a + b)
            want[right] *= a / (a + b)
            share(left)
            share(right)

    share(order)
    np.testing.assert_allclose(portfolio.parity_weights(cov, order, 0.0), want, rtol=1e-9)


def test_short_history_gives_equal_weights(spark):
    rows = [("a", "a", 0.1, 1.0), ("a", "b", 0.0, 0.0), ("b", "a", 0.0, 0.0), ("b", "b", 0.4, 1.0)]
    strength = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.5)], "date int, ticker string, strength double")
    for n, equal in ((19, True), (20, False)):
        moments = spark.createDataFrame([(1, *r, n) for r in rows], "date int, a string, b string, cov double, corr double, rows int")
        for weights in (portfolio.hrp_weights, portfolio.black_litterman_weights):
            got = [r["weight"] for r in weights(moments, strength, cap=0.9).collect()]
            assert (abs(got[0] - got[1]) < 1e-12) == equal and abs(sum(got) - 1) < 1e-12


def test_settings_give_each_profile_its_weights(spark):
    rows = [("a", "a", 0.1, 1.0), ("a", "b", 0.01, 0.05), ("b", "a", 0.01, 0.05), ("b", "b", 0.4, 1.0)]
    moments = spark.createDataFrame([(1, *r, 99) for r in rows], "date int, a string, b string, cov double, corr double, rows int")
    strength = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.5)], "date int, ticker string, strength double")
    profiles = [backtest.Profile("x", 0.5, 0.8, 2.0), backtest.Profile("y", 0.9, 0.6, 3.0)]
    settings = backtest.profile_table(spark, profiles)
    for weights, more in ((portfolio.hrp_weights, ()), (portfolio.black_litterman_weights, ("delta", "tau"))):
        got = {(r["profile"], r["ticker"]): r["weight"] for r in weights(moments, strength, settings=settings).collect()}
        for p in profiles:
            alone = weights(moments, strength, confidence=p.confidence, cap=p.cap, **{k: getattr(p, k) for k in more})
            assert {(p.name, r["ticker"]): r["weight"] for r in alone.collect()} == {k: w for k, w in got.items() if k[0] == p.name}


def test_mean_variance_without_convergence_is_an_error():
    with pytest.raises(ArithmeticError):
        portfolio.mean_variance_vector(np.array([0.1, 0.2]), np.eye(2) * 0.01, np.zeros(2), 3.0, 0.001, rounds=1)


def test_engine_refuses_bad_prices(spark):
    _, bars = prices(spark)
    signals = spark.createDataFrame([("t0", 1)], "ticker string, signal int")
    with pytest.raises(ValueError, match="missing prices"):
        backtest.engine_weights(bars.withColumn("close", F.when(F.col("ticker") != "t1", F.col("close"))), signals)
    with pytest.raises(ValueError, match="too few rows"):
        backtest.engine_weights(bars.limit(5), signals)


def prices(spark, n=90, seed=5):
    rng = np.random.default_rng(seed)
    frames = []
    for k, start in enumerate((0, 0, 12)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        ts = pd.date_range("2024-01-01", periods=n, freq="D")
        keep = (np.arange(n) >= start) & ((np.arange(n) % 9 != 4) | (k != 1))
        frames.append(pd.DataFrame({"ticker": f"t{k}", "ts": ts[keep], "close": close[keep]}))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf)


def test_window_returns_match_slices(spark):
    """Windows shorter than the history, a late ticker and gaps."""
    pdf, bars = prices(spark)
    days = bars.select(F.to_date("ts").alias("date")).distinct()
    rows, price_rows = panel.window_returns(bars, days, span_days=40, at_least=20, block=16)
    got = panel.unpacked(rows).toPandas()
    sizes = price_rows.toPandas().set_index("date")
    for date in sorted(pdf.ts.unique())[::7]:
        parts = {}
        for t, g in pdf.groupby("ticker"):
            s = g.set_index("ts").close
            s = s[(s.index >= date - pd.Timedelta(days=40)) & (s.index <= date)]
            if len(s) >= 20:
                parts[t] = s
        mine = got[got.date == pd.Timestamp(date).date()]
        if not parts:
            assert mine.empty
            continue
        frame = pd.DataFrame(parts).sort_index().ffill().dropna(how="all")
        want = frame.pct_change(fill_method=None).dropna()
        assert sizes.loc[pd.Timestamp(date).date(), "price_rows"] == len(frame)
        table = mine.pivot(index="ts", columns="ticker", values="ret") if len(mine) else pd.DataFrame()
        assert len(table) == len(want)
        if len(want):
            np.testing.assert_allclose(table.to_numpy(), want[table.columns].to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("broken", [False, True])
def test_running_sums_give_the_windows_facts(spark, broken):
    """The same facts as from the rows of each window; with a zero price, returns are missing in some windows."""
    pdf, bars = prices(spark)
    if broken:
        hole = (F.col("ticker") == "t0") & (F.col("ts") == F.lit("2024-02-15").cast("timestamp"))
        bars = bars.withColumn("close", F.when(hole, 0.0).otherwise(F.col("close")))
    days = bars.select(F.to_date("ts").alias("date")).distinct()
    rows, price_rows = panel.window_returns(bars, days, span_days=40, at_least=20, block=16)
    want = portfolio.window_facts(rows, 9).toPandas().set_index(["date", "a", "b"]).sort_index()
    facts, priced = trailing.window_facts(bars, days, span_days=40, at_least=20, recent=9, block=16)
    got = facts.toPandas().set_index(["date", "a", "b"]).sort_index()
    assert got.index.equals(want.index) and len(got) > 100
    for c in ("rows", "mean", "cov", "corr", "late_corr", "late_mean", "late_std", "std"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-8, atol=1e-12, err_msg=c)
    own = got.index.get_level_values("a") == got.index.get_level_values("b")
    for c in ("win_rate", "avg_gain", "avg_loss"):
        np.testing.assert_allclose(got[c][own].to_numpy(float), want[c][own].to_numpy(float), rtol=1e-8, err_msg=c)
    key = lambda d: sorted(tuple(r) for r in d.select("date", "n_tickers", "price_rows").collect())
    assert key(priced) == key(price_rows)


def test_moments_match_numpy(spark):
    pdf, bars = prices(spark)
    rets = metrics.simple_returns(bars, ["ticker"], block=16)
    got = metrics.pair_moments(rets).toPandas()
    wide = rets.toPandas().pivot(index="ts", columns="ticker", values="ret")
    for r in got.itertuples():
        want = wide.dropna().cov().loc[r.a, r.b]
        assert abs(r.cov - want) < 1e-12


def test_accounting_against_a_day_loop(spark):
    pdf, bars = prices(spark, 30)
    days = sorted(pdf.ts.unique())
    chosen = {days[5]: {"t0": 0.7, "t1": 0.3}, days[17]: {"t2": 2.0, "t0": 2.0}}
    rows = [("p", pd.Timestamp(d).date(), t, w) for d, ws in chosen.items() for t, w in ws.items()]
    weights = spark.createDataFrame(rows, "profile string, date date, ticker string, weight double")
    states = weights.select("date").distinct().select("date", F.lit("bull").alias("regime"), F.lit("Kelly").alias("optimizer"))
    sure = weights.select("date", F.lit(0.9).alias("confidence")).distinct()
    got = backtest.account(weights, states, bars, sure, 1000.0, commission_bps=10.0).toPandas().sort_values("date")
    wide = pdf.pivot(index="ts", columns="ticker", values="close").ffill()
    rets = wide.pct_change(fill_method=None).fillna(0.0)
    held = {t: 1 / 3 for t in wide.columns}
    value = bench = 1000.0
    for i, day in enumerate(days[:-1]):
        new = held
        if day in chosen:
            total = sum(chosen[day].values())
            new = {t: chosen[day].get(t, 0.0) / total for t in wide.columns}
        cost = sum(abs(new[t] - held[t]) for t in new) * 10 / 10_000
        held = new
        value *= 1 + sum(held[t] * rets.loc[days[i + 1], t] for t in held) - cost
        bench *= 1 + sum(rets.loc[days[i + 1], t] / 3 for t in held)
        row = got.iloc[i]
        assert row.portfolio_value == pytest.approx(value, abs=2e-4)
        assert row.benchmark_value == pytest.approx(bench, abs=2e-4)
        assert row.regime == ("neutral" if i < 5 else "bull")
    assert len(got) == len(days) - 1


def test_auc_in_many_slices(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 3000), "y_prob": np.round(rng.normal(size=3000), 2), "y_true": rng.integers(0, 2, 3000)})
    got = metrics.auc(spark.createDataFrame(pdf), ["g"]).toPandas().set_index("g").auc
    for g, part in pdf.groupby("g"):
        p, n = part[part.y_true == 1].y_prob.to_numpy(), part[part.y_true == 0].y_prob.to_numpy()
        want = ((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean()
        assert got[g] == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_half(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("a", 0.9, 1)], "g string, y_prob double, y_true int")
    assert metrics.auc(df, ["g"]).first()["auc"] == 0.5


@pytest.mark.parametrize("optimizer", ["markowitz", "hrp"])
def test_engine_weights_are_a_portfolio(spark, optimizer):
    _, bars = prices(spark)
    signals = spark.createDataFrame([("t0", 1), ("t1", 1), ("t2", -1)], "ticker string, signal int")
    got = backtest.engine_weights(bars, signals, "low", optimizer).toPandas().set_index("ticker").weight
    assert got["t2"] == 0 and abs(got.sum() - 1) < 1e-9 and got.min() >= 0
    same = backtest.engine_weights(
        bars, signals, "low", optimizer, previous=spark.createDataFrame([(t, float(w) + 0.001) for t, w in got.items()], "ticker string, weight double")
    ).toPandas().set_index("ticker").weight
    assert abs(same["t0"] - got["t0"] - 0.001) < 1e-9
