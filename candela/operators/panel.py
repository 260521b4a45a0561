"""Panels: several tickers on one clock, as-of and trailing joins, weights against returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.timeline import BLOCK, bounded, number, running
from candela.session import checkpointed


CHUNK = 10_000  # names that travel in one row, about


def with_each(df: DataFrame, names: DataFrame, column: str = "ticker") -> DataFrame:
    """Every row of ``df`` with every name of a table's column, as the panel's definition asks for.

    Names are packed into rows of about ``CHUNK``; rows meet them by an equi-join on the chunk's number, whatever their count.
    """
    each = names.select(column).filter(F.col(column).isNotNull()).distinct()
    chunks = max(1, -(-each.count() // CHUNK))
    number = F.pmod(F.xxhash64(column), F.lit(chunks)).cast("int")
    packed = each.groupBy(number.alias("_chunk")).agg(F.collect_list(column).alias("_names"))
    spread = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return spread.join(packed, "_chunk").withColumn(column, F.explode("_names")).drop("_chunk", "_names")


def align_panel(bars: DataFrame, columns: Sequence[str] = ("close",), block: int = BLOCK) -> DataFrame:
    """Every ticker at every time any ticker has, gaps filled forward (missing before a ticker starts).

    ``seen`` is the time of the bar a row's values come from.
    """
    grid = with_each(bars.select("ts").distinct(), bars).join(
        bars.select("ticker", "ts", *columns, F.col("ts").alias("_at")), ["ticker", "ts"], "left"
    )
    fills = {f"_f_{c}": ("last", F.col(c)) for c in columns} | {"seen": ("last", F.col("_at"))}
    filled = running(number(grid), fills, block=block)
    return filled.select("ticker", "ts", "pos", "seen", *[F.col(f"_f_{c}").alias(c) for c in columns])


def daily_last(panel: DataFrame, value: str = "close") -> DataFrame:
    """Last value of each ticker and day."""
    return panel.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.max_by(value, "ts").alias(value))


def daily_returns(daily: DataFrame, value: str = "close") -> DataFrame:
    """Change from day to day, 0 on the first. A daily series is as long as the calendar, not the data."""
    w = Window.partitionBy("ticker").orderBy("date")
    change = F.try_divide(F.col(value), F.lag(value).over(w)) - 1
    return daily.withColumn("ret", F.coalesce(change, F.lit(0.0)))


def latest_on_day(signals: DataFrame, days: DataFrame, values: Sequence[str]) -> DataFrame:
    """For each ticker and day: the last signal of that day or of the last earlier day that has one.

    Signals shrink to one row per ticker and day first (map-side combine), so what is ordered per ticker
    afterwards is no longer than the calendar.
    """
    last = signals.groupBy("ticker", F.to_date("ts").alias("_from")).agg(*[F.max_by(v, "ts").alias(v) for v in values])
    # A signal is known from its day to the day before the next one.
    end = days.agg(F.max("date")).scalar()
    w = Window.partitionBy("ticker").orderBy("_from")
    held = last.withColumn("_next", F.lead("_from").over(w)).withColumn("_end", end)
    held = held.withColumn("_until", F.least(F.coalesce(F.date_sub("_next", 1), F.col("_end")), F.col("_end")))
    each = held.filter(F.col("_from") <= F.col("_until")).withColumn("date", F.explode(F.sequence("_from", "_until")))
    return each.join(days.select("date").distinct(), "date", "left_semi").select("ticker", "date", *values)


def trailing_slices(panel: DataFrame, days: DataFrame, span_days: int = 365, until=None) -> DataFrame:
    """``date`` with the panel rows in ``[date - span, date]`` (and before ``until``).

    Days and rows meet on 30-day buckets of time, so the join is an equi-join; the planner broadcasts the calendar if it is small.
    """
    width = 30
    bucket = lambda days_since: F.floor(days_since / F.lit(width))
    d = days.select("date").distinct().withColumn(
        "_bucket",
        F.explode(F.sequence(bucket(F.unix_date("date") - span_days), bucket(F.unix_date("date")))),
    )
    rows = panel if until is None else panel.filter(F.col("ts") < F.lit(until))
    rows = rows.withColumn("_bucket", bucket(F.unix_date(F.to_date("ts"))))
    start = F.col("date").cast("timestamp") - F.expr(f"INTERVAL {span_days * 24} HOURS")
    return (
        rows.join(d, "_bucket")
        .withColumn("_start", start)
        .filter((F.col("ts") >= F.col("_start")) & (F.col("ts") <= F.col("date").cast("timestamp")))
        .drop("_bucket")
    )


def window_returns(
    bars: DataFrame, days: DataFrame, span_days: int = 365, at_least: int = 30, until=None, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """``date, ts, cells`` for the trailing window of each day, and the number of price rows in it.

    ``cells`` holds one (ticker, ret) per ticker of the window: those with at least ``at_least`` own bars
    in it. Gaps are filled forward inside the window only, and a time counts when every ticker of the
    window has a return there. A time is one row with an array of tickers, so the many (day, time) pairs
    are filtered and aggregated where the join makes them and are not shuffled themselves.
    """
    change = lambda f: {"ret": F.try_divide(F.col("close"), f.lag("close")) - 1, "before": f.lag("seen")}
    panel = bounded(align_panel(bars, block=block), [change], back=1, block=block)
    cell = F.struct("ticker", "ret", "before", "seen", (F.col("seen") == F.col("ts")).alias("own"))
    clock = panel.filter(F.col("seen").isNotNull()).groupBy("ts").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    # Each time meets up to span_days days below, so even a short clock is spread over all cores first.
    cores = bars.sparkSession.sparkContext.defaultParallelism
    rows = trailing_slices(checkpointed(clock.repartition(cores, "ts")), days, span_days, until)
    own = rows.select("date", F.explode(F.filter("cells", lambda c: c["own"])).alias("_c")).select("date", "_c.ticker")
    enough = own.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= at_least)
    held = enough.groupBy("date").agg(F.collect_set("ticker").alias("_held"))
    rows = rows.join(held, "date").withColumn("cells", F.filter("cells", lambda c: F.array_contains("_held", c["ticker"])))
    n = F.size("_held")
    priced = F.exists("cells", lambda c: c["seen"] >= F.col("_start"))
    price_rows = rows.filter(priced).groupBy("date", n.alias("n_tickers")).agg(F.count(F.lit(1)).alias("price_rows"))
    valid = F.filter("cells", lambda c: c["ret"].isNotNull() & (c["before"] >= F.col("_start")))
    complete = rows.withColumn("cells", valid).filter(F.size("cells") == n)
    slim = F.transform("cells", lambda c: F.struct(c["ticker"].alias("ticker"), c["ret"].alias("ret")))
    return complete.select("date", "ts", slim.alias("cells")), price_rows


def unpacked(rows: DataFrame) -> DataFrame:
    """One row per ticker: ``date, ts, ticker, ret``."""
    return rows.select("date", "ts", F.explode("cells").alias("_c")).select("date", "ts", "_c.*")


def spread_weights(weights: DataFrame, universe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights for the whole universe (0 where absent), brought back to sum 1 per group. Tickers outside the universe have no weight."""
    keys = list(keys)
    full = with_each(weights.select(*keys).distinct(), universe).join(weights, keys + ["ticker"], "left")
    total = full.groupBy(*keys).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("_total"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_total") > 0, F.coalesce("weight", F.lit(0.0)) / F.nullif("_total", F.lit(0.0)))
    return full.join(total, keys).select(*keys, "ticker", F.coalesce(share, 1.0 / F.col("_n")).alias("weight"))


def next_day_returns(weights: DataFrame, returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Portfolio return of the day after each date: sum of weight times next trading day's return."""
    keys = list(keys)
    days = returns.select("date").distinct()
    after = days.withColumn("next_date", F.lead("date").over(Window.orderBy("date"))).filter(F.col("next_date").isNotNull())
    following = returns.select(F.col("date").alias("next_date"), "ticker", "ret")
    return (
        weights.join(after, "date")
        .join(following, ["next_date", "ticker"])
        .groupBy(*keys, "date")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )


def weight_change(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest absolute change of a weight per group; a ticker absent on one side counts as 0."""
    keys = list(keys)
    both = old.withColumnRenamed("weight", "_old").join(new.withColumnRenamed("weight", "_new"), keys + ["ticker"], "full")
    change = F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))
    return both.groupBy(*keys).agg(F.max(change).alias("max_change"))


def keep_small_changes(old: DataFrame, new: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """New weights, or the old ones where no weight moves by ``threshold``; groups without old weights are new."""
    keys = list(keys)
    known = old.select(*keys).distinct().withColumn("_known", F.lit(True))
    moved = weight_change(old, new, keys).join(known, keys, "left")
    verdict = moved.select(*keys, (F.col("_known").isNotNull() & (F.col("max_change") < threshold)).alias("_keep"))
    kept = old.join(verdict.filter("_keep"), keys, "left_semi")
    taken = new.join(verdict.filter("_keep"), keys, "left_anti")
    return kept.unionByName(taken)


def thin(df: DataFrame, keys: Sequence[str], every: int = 10) -> DataFrame:
    """Every n-th row and the last one of each series."""
    rows = number(df, keys)
    last = rows.groupBy(*keys).agg(F.max("pos").alias("_last"))
    return rows.join(last, list(keys)).filter(((F.col("pos") - 1) % every == 0) | (F.col("pos") == F.col("_last"))).drop("_last")


def latest(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Values of each series' last row."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("ts", *values), "ts").alias("_r")).select(*keys, "_r.*")


def lagged(df: DataFrame, columns: dict[str, Column | str], block: int = BLOCK) -> DataFrame:
    """Columns shifted by one row of their series."""
    return bounded(number(df), [lambda f: {n: f.lag(c) for n, c in columns.items()}], back=1, block=block)
