"""Daily portfolio accounting for a set of signals, and the second weight engine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.operators import cleaning, metrics, panel, portfolio, trailing
from candela.session import checkpointed


@dataclass(frozen=True)
class Profile:
    """Settings of one investor profile."""

    name: str
    confidence: float = 0.7
    cap: float = 0.4
    delta: float = 2.5
    tau: float = 0.05


# The three profiles' confidence, largest weight, risk aversion and looseness of the prior.
PROFILES = [
    Profile("low", confidence=0.65, cap=0.25, delta=3.5, tau=0.05),
    Profile("medium", confidence=0.70, cap=0.30, delta=2.5, tau=0.05),
    Profile("high", confidence=0.75, cap=0.40, delta=1.5, tau=0.05),
]


def daily_weights(bars: DataFrame, signals: DataFrame, days: DataFrame, profiles: Sequence[Profile], until=None) -> DataFrame:
    """Weights for the days with enough history and signals: ``profile, date, regime, optimizer, ticker, weight``.

    ``signals(date, ticker, strength)`` holds the latest signal known on each day. Windows, regimes and
    moments do not depend on the profile and are made once.
    """
    facts, price_rows = trailing.window_facts(bars, days, until=until)
    known = signals.groupBy("date").agg(F.count(F.lit(1)).alias("_known"))
    ready = price_rows.filter((F.col("n_tickers") >= 2) & (F.col("price_rows") >= 30)).join(
        known.filter(F.col("_known") >= 2).select("date"), "date", "left_semi"
    )
    facts = checkpointed(facts)
    states = portfolio.regime(portfolio.regime_facts(facts, ready))
    states = checkpointed(states.select("date", "regime", portfolio.optimizer_for("regime").alias("optimizer")))
    of = lambda df, name: df.join(states.filter(F.col("optimizer") == name).select("date"), "date", "left_semi")
    kelly = of(portfolio.kelly_facts(facts), "Kelly")
    moments = metrics.mirrored(facts.select("date", "a", "b", "cov", "corr", "rows"), ["date"])
    # A ticker of the window without a signal counts as a neutral one.
    held = facts.filter("a = b").select("date", F.col("a").alias("ticker"))
    held = held.join(signals, ["date", "ticker"], "left").select("date", "ticker", F.coalesce("strength", F.lit(0.0)).alias("strength"))
    held = checkpointed(held)
    settings = profile_table(bars.sparkSession, profiles)
    parts = [
        portfolio.kelly_weights(kelly, held, settings=settings),
        portfolio.hrp_weights(of(moments, "HRP"), held, settings=settings),
        portfolio.black_litterman_weights(of(moments, "Black-Litterman"), held, settings=settings),
    ]
    columns = ["profile", "date", "ticker", "weight"]
    out = parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))
    return states.join(out, "date")


def profile_table(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """One row for each profile."""
    rows = [(p.name, p.confidence, p.cap, p.delta, p.tau) for p in profiles]
    return spark.createDataFrame(rows, "profile string, confidence double, cap double, delta double, tau double")


def account(
    weights: DataFrame, states: DataFrame, bars: DataFrame, confidence: DataFrame, capital: float = 1_000.0, commission_bps: float = 0.0
) -> DataFrame:
    """The daily result table from weights ``(profile, date, ticker, weight)`` of some days.

    Days without weights of their own keep the last ones (equal weights at the start); each day earns the
    next trading day's returns. A ticker that isn't traded keeps its weight and earns nothing. The result has the whole universe in
    one map a day, so the equal weights are a map of that size too.
    """
    daily = checkpointed(panel.daily_returns(panel.daily_last(panel.align_panel(bars))))
    universe = daily.select("ticker").distinct()
    days = daily.select("date").distinct()
    full = panel.spread_weights(weights, universe.union(weights.select("ticker")).distinct(), ["profile", "date"])
    sets = full.groupBy("profile", "date").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "weight")))).alias("_w")
    )
    equal = F.map_from_arrays("_t", F.transform("_t", lambda _: F.lit(1.0) / F.size("_t")))
    # One row per profile and day from here on: the calendar's length.
    order = Window.partitionBy("profile").orderBy("date")
    marked = sets.join(states, "date", "left")
    calendar = panel.with_each(days.withColumn("_open", F.lit(True)), weights, "profile").join(marked, ["profile", "date"], "full")
    traded = universe.agg(F.sort_array(F.collect_list("ticker"))).scalar()
    calendar = calendar.join(confidence, "date", "left").withColumn("_t", traded)
    held = calendar.select(
        "profile",
        "date",
        "_open",
        F.coalesce(F.last("_w", ignorenulls=True).over(order), equal).alias("held"),
        F.coalesce(F.last("regime", ignorenulls=True).over(order), F.lit("neutral")).alias("regime"),
        F.coalesce(F.last("optimizer", ignorenulls=True).over(order), F.lit("Black-Litterman")).alias("optimizer"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        equal.alias("equal"),
    ).filter("_open")
    before = F.lag("held").over(order)
    held = held.withColumns({"_before": F.coalesce(before, F.col("held")), "_next": F.lead("date").over(order)})
    turnover = F.aggregate(
        F.map_values(F.map_zip_with("held", "_before", lambda _, a, b: F.abs(a - b))), F.lit(0.0), lambda s, x: s + x
    )
    rets = daily.groupBy(F.col("date").alias("_next")).agg(F.map_from_entries(F.collect_list(F.struct("ticker", "ret"))).alias("_r"))
    earned = lambda w: F.aggregate(
        F.map_values(F.map_zip_with(w, "_r", lambda _, a, b: F.coalesce(a * b, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x
    )
    table = held.join(rets, "_next").withColumns(
        {"_p": earned("held") - turnover * (commission_bps / 10_000.0), "_b": earned("equal")}
    )
    grown = lambda c: F.round(F.lit(float(capital)) * F.product(1 + F.col(c)).over(order), 4)
    return table.select(
        "profile",
        "date",
        grown("_p").alias("portfolio_value"),
        grown("_b").alias("benchmark_value"),
        F.transform_values("held", lambda _, w: F.round(w, 4)).alias("allocations"),
        F.round("confidence", 4).alias("confidence"),
        "regime",
        "optimizer",
    )


def run_profiles(
    bars: DataFrame, signals: DataFrame, profiles: Sequence[Profile], cutoff=None, capital: float = 1_000.0, history_until=None
) -> DataFrame:
    """Daily results of all profiles from signals ``(ticker, ts, prob_up, signal_strength)``.

    ``cutoff`` is the first day traded; ``history_until`` ends the prices that weights may use.
    """
    traded = bars if cutoff is None else cleaning.since(bars, cutoff)
    days = traded.select(F.to_date("ts").alias("date")).distinct()
    latest = checkpointed(panel.latest_on_day(signals, days, ["prob_up", "signal_strength"]))
    strength = latest.select("date", "ticker", F.col("signal_strength").alias("strength"))
    chosen = checkpointed(daily_weights(bars, strength, days, profiles, history_until))
    states = chosen.select("date", "regime", "optimizer").distinct()
    weights = chosen.select("profile", "date", "ticker", "weight")
    return account(weights, states, traded, mean_confidence(latest), capital)


def mean_confidence(latest: DataFrame) -> DataFrame:
    """Per day: mean probability of a rise, counted from a coin toss up."""
    clipped = F.least(F.greatest("prob_up", F.lit(0.5)), F.lit(1.0))
    return latest.groupBy("date").agg(F.avg(clipped).alias("confidence"))


# ---- second engine -----------------------------------------------------------------------------

# Risk aversion, lookback rows and rebalance threshold by risk profile.
ENGINE_DEFAULTS = {
    "low": {"risk": 6.0, "lookback": 225, "threshold": 0.05},
    "high": {"risk": 3.0, "lookback": 130, "threshold": 0.01},
    "other": {"risk": 2.0, "lookback": 160, "threshold": 0.02},
}


def engine_weights(
    prices: DataFrame, signals: DataFrame, profile: str = "low", optimizer: str = "markowitz", previous: DataFrame | None = None, penalty: float = 0.001
) -> DataFrame:
    """Weights ``(ticker, weight)`` from daily prices ``(ticker, ts, close)`` and signals ``(ticker, signal)``.

    Long tickers only (all if none is long), the last rows of the price panel, one optimisation, zeros for
    the rest, and the previous weights when the change is below the threshold.
    """
    broken = cleaning.check_prices(prices.filter(F.col("ts").isNotNull()), ["close"], at_least=10)
    rules = [r["rule"] for r in broken.limit(3).collect()]
    if rules:
        raise ValueError(f"prices can't be used: {', '.join(rules)}")
    settings = ENGINE_DEFAULTS.get(profile, ENGINE_DEFAULTS["other"])
    whole = signals.withColumn("_all", F.lit(1))
    longs = cleaning.long_only(whole, ["_all"]).select("ticker")
    aligned = panel.align_panel(prices).select("ticker", "ts", "close", "pos")
    window = cleaning.lookback(aligned, settings["lookback"]).join(longs, "ticker", "left_semi").drop("pos")
    returns = metrics.simple_returns(window, ["ticker"])
    if optimizer == "hrp":
        returns = returns.withColumn("ret", F.ln(1 + F.col("ret")))
    returns = checkpointed(returns.select(F.lit(1).alias("_all"), "ticker", "ts", "ret"))
    moments = metrics.pair_moments(returns, ["_all"])
    if optimizer == "hrp":
        solved = portfolio.plain_hrp_weights(moments, returns.select("_all", "ticker").distinct(), ["_all"])
    elif optimizer == "markowitz":
        means = returns.groupBy("_all", "ticker").agg(F.avg("ret").alias("mu"))
        old = F.lit(0.0).alias("previous")
        if previous is not None:
            means = means.join(previous.select("ticker", F.col("weight").alias("previous")), "ticker", "left")
            old = F.coalesce("previous", F.lit(0.0)).alias("previous")
        means = means.select("_all", "ticker", "mu", old)
        solved = portfolio.mean_variance_weights(moments, means, ["_all"], settings["risk"], penalty)
    else:
        raise ValueError(f"optimizer must be hrp or markowitz, got {optimizer!r}")
    solved = checkpointed(panel.spread_weights(solved, aligned, ["_all"]))
    if previous is not None:
        old_weights = previous.select(F.lit(1).alias("_all"), "ticker", "weight")
        solved = panel.keep_small_changes(old_weights, solved, ["_all"], settings["threshold"])
    return solved.select("ticker", "weight")
