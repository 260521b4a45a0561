"""Facts of many trailing windows at once, from running sums.

The windows of two neighbouring days share almost all their rows. So sums and products run along the clock once, per ticker and per
pair of tickers, and a window's value is the difference of two of them: work grows with times + dates, not with times x dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.operators import panel, portfolio
from candela.operators.timeline import BLOCK, bounded, running
from candela.session import checkpointed

SUMS = ["x", "y", "xx", "yy", "xy"]
OWN = ["up", "gain", "gains", "loss", "losses"]


def window_edges(clock: DataFrame, days: DataFrame, span_days: int) -> DataFrame:
    """``date, lo, hi``: the window of each day holds the clock's positions lo + 1 to hi.

    ``clock(ts)`` has a row for each time. Counts run over a calendar of one row a day, which is a few thousand rows for decades.
    """
    midnight = F.col("ts") == F.to_date("ts").cast("timestamp")
    per_day = clock.groupBy(F.to_date("ts").alias("_day")).agg(F.count(F.lit(1)).alias("_n"), F.max(midnight.cast("int")).alias("_m"))
    asked = days.select("date").distinct()
    ends = asked.agg(F.date_sub(F.min("date"), span_days).alias("a"), F.max("date").alias("z")).filter("z IS NOT NULL")
    first = F.least(F.col("a"), per_day.agg(F.min("_day")).scalar())
    spine = ends.select(F.explode(F.sequence(first, F.col("z"))).alias("_day")).join(per_day, "_day", "left")
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    counted = checkpointed(spine.select("_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_c"), F.coalesce("_m", F.lit(0)).alias("_m")))
    hi = counted.select(F.col("_day").alias("date"), (F.col("_c") + F.col("_m")).alias("hi"))
    lo = counted.select(F.date_add("_day", span_days).alias("date"), F.col("_c").alias("lo"))
    return asked.join(hi, "date").join(lo, "date").filter("hi > lo")


def held_tickers(rows: DataFrame, edges: DataFrame, at_least: int) -> DataFrame:
    """``date, ticker, f, lo, hi, bad``: tickers with at least so many own bars in the window, the position of the first of them, and
    how many missing returns the ticker has had up to the window's end. ``rows`` has pos, owned and bad, running counts, and bar (an own bar there)."""
    at = rows.select("ticker", "pos", "owned", "bad")
    upper = edges.join(at.withColumnRenamed("pos", "hi"), "hi")
    lower = edges.join(at.select("ticker", F.col("pos").alias("lo"), F.col("owned").alias("_before")), "lo").select("date", "ticker", "_before")
    both = upper.join(lower, ["date", "ticker"], "left").withColumn("_before", F.coalesce("_before", F.lit(0.0)))
    enough = both.filter(F.col("owned") - F.col("_before") >= at_least)
    bars = rows.filter("bar").select("ticker", (F.col("owned") - 1).alias("_before"), F.col("pos").alias("f"))
    return enough.join(bars, ["ticker", "_before"]).select("date", "ticker", "f", "lo", "hi", "bad")


def _between(wanted: DataFrame, sums: DataFrame, keys: list[str], names: list[str], upper: str, lower: str, prefix: str = "") -> DataFrame:
    """``wanted`` with the differences of running sums between two of its position columns."""
    for column, mark in ((upper, "_u_"), (lower, "_v_")):
        side = sums.select(*keys, F.col("pos").alias(column), *[F.col(n).alias(f"{mark}{n}") for n in names])
        wanted = wanted.join(side, [*keys, column])
    made = wanted.withColumns({f"{prefix}{n}": F.col(f"_u_{n}") - F.col(f"_v_{n}") for n in names})
    return made.drop(*[f"{m}{n}" for m in ("_u_", "_v_") for n in names])


def _spread(total: str, square: str, n: str) -> Column:
    """Sample variance from running sums; what is left by rounding alone counts as 0."""
    raw = F.try_divide(F.col(square) - F.col(total) * F.col(total) / F.nullif(F.col(n), F.lit(0)), F.col(n) - 1)
    return F.when(raw <= 1e-13 * F.col(square) / F.nullif(F.col(n), F.lit(0)), 0.0).otherwise(raw)


def window_facts(
    bars: DataFrame, days: DataFrame, span_days: int = 365, at_least: int = 30, recent: int = 60, until=None, logs: bool = False,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """All that regimes and weights need from the trailing window of each day, and ``date, n_tickers, price_rows``.

    One row per date and pair ``a <= b`` of tickers held: covariance and correlation, correlation of the last ``recent`` rows, and on
    ``a = b`` the ticker's own mean, deviation, late mean and deviation, win rate, mean gain and mean loss. A row of a window counts when
    every ticker held has a return inside it; as gaps are filled forward, these are all rows after the last ticker's first own bar.
    Dates in whose window a return is missing even so are worked out from their rows (``panel.window_returns``). ``logs``: log returns.
    """
    change = lambda f: {"ret": F.try_divide(F.col("close"), f.lag("close")) - 1, "before": f.lag("seen")}
    aligned = bounded(panel.align_panel(bars, block=block), [change], back=1, block=block)
    aligned = aligned if until is None else aligned.filter(F.col("ts") < F.lit(until))
    ret = F.ln(1 + F.col("ret")) if logs else F.col("ret")
    own = F.col("seen").isNotNull() & (F.col("seen") == F.col("ts"))
    rows = checkpointed(aligned.select("ticker", "ts", "pos", ret.alias("ret"), own.alias("bar"), F.col("before").isNotNull().alias("after")))
    missing = F.col("after") & F.col("ret").isNull()
    counted = checkpointed(
        running(rows, {"owned": ("sum", F.col("bar").cast("double")), "bad": ("sum", missing.cast("double"))}, block=block)
    )
    edges = checkpointed(window_edges(rows.select("ts").distinct(), days, span_days))
    held = checkpointed(held_tickers(counted, edges, at_least))
    dates = held.groupBy("date", "hi").agg(
        F.count(F.lit(1)).alias("n_tickers"), F.min("f").alias("_first"), F.max("f").alias("start")
    )
    price_rows = dates.select("date", "n_tickers", (F.col("hi") - F.col("_first") + 1).alias("price_rows"))
    late = F.greatest(F.col("start"), F.col("hi") - recent)
    dates = dates.select("date", "start", late.alias("late"), (F.col("hi") - F.col("start")).alias("rows"), (F.col("hi") - late).alias("late_rows"))
    dates = dates.filter("rows > 0")
    each = held.select("date", "ticker", "hi", "bad").join(dates, "date")
    at_start = counted.select("ticker", F.col("pos").alias("start"), F.col("bad").alias("_bad"))
    broken = each.join(at_start, ["ticker", "start"]).filter(F.col("bad") > F.col("_bad")).select("date").distinct()
    broken = checkpointed(broken)

    # Sums of returns less the ticker's mean lose the fewest digits.
    means = rows.groupBy("ticker").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mean"))
    centred = checkpointed(rows.join(means, "ticker").select("ticker", "pos", "ret", F.coalesce(F.col("ret") - F.col("mean"), F.lit(0.0)).alias("x")))
    a = centred.select("pos", F.col("ticker").alias("a"), "x")
    b = centred.select("pos", F.col("ticker").alias("b"), F.col("x").alias("y"))
    x, y, r = F.col("x"), F.col("y"), F.col("ret")
    pairs = a.join(b, "pos").filter("a <= b").select("pos", "a", "b", "x", "y")
    products = {"x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    sums = running(pairs.withColumns({f"_{k}": v for k, v in products.items()}).drop("x", "y"), {k: ("sum", F.col(f"_{k}")) for k in SUMS}, ["a", "b"], block)
    sums = checkpointed(sums.select("a", "b", "pos", *SUMS))
    single = {"up": r > 0, "gain": F.when(r > 0, r), "gains": r > 0, "loss": F.when(r < 0, r), "losses": r < 0}
    own_sums = running(centred, {k: ("sum", F.coalesce(v.cast("double"), F.lit(0.0))) for k, v in single.items()}, block=block)
    own_sums = own_sums.select("ticker", "pos", *OWN)

    good = each.join(broken, "date", "left_anti")
    meets = good.select("date", F.col("ticker").alias("a"), "hi", "start", "late", "rows", "late_rows").join(
        good.select("date", F.col("ticker").alias("b")), "date"
    ).filter("a <= b")
    full = _between(meets, sums, ["a", "b"], SUMS, "hi", "start")
    full = _between(full, sums, ["a", "b"], SUMS, "hi", "late", "late_")
    cov = lambda p, n: F.try_divide(F.col(f"{p}xy") - F.col(f"{p}x") * F.col(f"{p}y") / F.col(n), F.col(n) - 1)
    corr = lambda p, n: F.try_divide(cov(p, n), F.sqrt(_spread(f"{p}x", f"{p}xx", n)) * F.sqrt(_spread(f"{p}y", f"{p}yy", n)))
    facts = full.join(means.withColumnRenamed("ticker", "a"), "a").select(
        "date", "a", "b", cov("", "rows").alias("cov"), corr("", "rows").alias("corr"), corr("late_", "late_rows").alias("late_corr"),
        (F.col("late_x") / F.col("late_rows") + F.col("mean")).alias("late_mean"),
        F.sqrt(_spread("late_x", "late_xx", "late_rows")).alias("late_std"), F.sqrt(_spread("x", "xx", "rows")).alias("std"), "rows",
        (F.col("x") / F.col("rows") + F.col("mean")).alias("mean"),
    )
    alone = _between(good.select("date", "ticker", "hi", "start", "rows"), own_sums, ["ticker"], OWN, "hi", "start")
    share = lambda total, n: F.try_divide(F.col(total), F.nullif(F.round(n), F.lit(0.0)))
    alone = alone.select(
        "date", F.col("ticker").alias("a"), F.col("ticker").alias("b"), (F.round("up") / F.col("rows")).alias("win_rate"),
        F.coalesce(share("gain", "gains"), F.lit(0.01)).alias("avg_gain"), F.coalesce(F.abs(share("loss", "losses")), F.lit(0.01)).alias("avg_loss"),
    )
    facts = facts.join(alone, ["date", "a", "b"], "left")
    if broken.limit(1).count():
        slow, _ = panel.window_returns(bars, broken, span_days, at_least, until, block)
        if logs:
            cells = F.transform("cells", lambda c: F.struct(c["ticker"].alias("ticker"), F.ln(1 + c["ret"]).alias("ret")))
            slow = slow.withColumn("cells", cells)
        facts = facts.unionByName(portfolio.window_facts(slow, recent).select(*facts.columns))
    return facts, price_rows
