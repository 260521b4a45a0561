"""All registered queries."""

from pyspark.sql import DataFrame, SparkSession

from candela.catalog import bars, evaluation, events, indicators, models, portfolio, report  # noqa: F401
from candela.catalog.base import QUERIES, SQL, shown
from candela.operators import events as detection
from candela.operators import indicators as ind
from candela.operators import labels
from candela.operators.timeline import number
from candela.sources.ticks import event_bars


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Events → hourly bars → bands and z-score → adaptive CUSUM → triple barrier → label summary."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bars_1h = number(event_bars(spark, folder))
    features = ind.compute(
        bars_1h, [ind.bbands(["bb_upper", "bb_lower", "bb_middle"], 20), ind.zscore("close__zscore", "close", 48)]
    )
    found = detection.adaptive_cusum(bars_1h, 1.0, 40)
    made = labels.triple_barrier(found, bars_1h, 0.5, 0.5, 24)
    known = features.select("ticker", "ts", "close__zscore").filter("close__zscore IS NOT NULL")
    kept = made.join(known.withColumnRenamed("ts", "event_ts"), ["ticker", "event_ts"], "left_semi")
    return shown(labels.label_summary(kept).fillna({"label": 0, "barrier": "all"}))
