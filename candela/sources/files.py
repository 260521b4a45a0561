"""OHLCV files in, result files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators.cleaning import normalise_ohlcv, with_history

NEEDED = ("open", "high", "low", "close", "volume")
DATE_NAMES = ("date", "datetime", "timestamp")


def read_ohlcv(
    spark: SparkSession, path: str, ticker: str, rename: dict[str, str] | None = None, date_column: str | None = None
) -> DataFrame:
    """Bars of one CSV file (or one file set with a common header) as ``ticker`` series."""
    raw = spark.read.option("header", True).csv(path)
    rename = rename or {}
    names = [rename.get(c, c).strip().lower() for c in raw.columns]
    raw = raw.toDF(*names)
    chosen = (date_column or "").strip().lower()
    date = next((c for c in (chosen, *DATE_NAMES) if c in names), names[0])
    absent = [c for c in NEEDED if c not in names]
    if absent:
        raise ValueError(f"missing columns {absent}")
    return raw.select(
        F.lit(ticker).alias("ticker"),
        F.col(f"`{date}`").try_cast("timestamp").alias("ts"),
        *[F.col(f"`{c}`").try_cast("double").alias(c) for c in NEEDED],
    ).dropna(subset=["ts", "close"])


# A comma outside quotes.
COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    """Cells of a CSV line, without quotes and outer blanks."""
    return F.transform(F.split(line, COMMA), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(f"{path.rstrip('/')}/*.csv").select("value", F.col("_metadata.file_name").alias("file"))
    return lines.withColumn("is_header", F.exists(_cells(F.lower("value")), lambda c: c.isin("close", "adj close", "adj_close")))


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``: CSV files of a folder that ``read_ohlcv_folder`` can't use, because no line names a close column."""
    return _lines(spark, path).groupBy("file").agg(F.max("is_header").alias("_h")).filter(~F.col("_h")).select("file")


def read_ohlcv_folder(spark: SparkSession, path: str, at_least: int = 100) -> DataFrame:
    """Bars of all CSV files of a folder; the ticker comes from the file name (``BTC-USD_1h.csv`` → BTC).

    Files may order and spell their columns differently, quote cells, and repeat the ticker in a second header
    line. An hourly file is preferred to a daily one. Lines are read as text so that large files split. Files
    without a close column are left out; ``rejected_files`` lists them.
    """
    lines = _lines(spark, path)
    headers = lines.filter("is_header").groupBy("file").agg(F.min("value").alias("header"))
    stem = F.regexp_replace(F.regexp_replace("file", r"\.csv$", ""), "%20", " ")
    hourly = stem.endswith("_1h")
    ticker = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "_1h", ""), "-USD", ""), "-", "")
    files = headers.select("file", "header", ticker.alias("ticker"), hourly.alias("hourly"))
    best = files.groupBy("ticker").agg(
        F.coalesce(F.max(F.when(F.col("hourly"), F.col("file"))), F.min("file")).alias("file")
    )
    files = files.join(best, ["ticker", "file"])
    rows = lines.filter("NOT is_header").join(files, "file")
    names = _cells(F.lower("header"))
    # The first column holds the date, whatever its name.
    names = F.transform(names, lambda c, i: F.when(i == 0, F.lit("_first")).otherwise(c))
    named = F.map_from_arrays(names, F.slice(F.concat(_cells(F.col("value")), F.array_repeat(F.lit(""), F.size(names))), 1, F.size(names)))
    rows = rows.select("ticker", _cells(F.col("value"))[0].alias("_date"), named.alias("_cell"))
    value = lambda name: F.replace(F.try_element_at("_cell", F.lit(name)), F.lit(",")).try_cast("double")
    adjusted = F.coalesce(value("adj close"), value("adj_close"), value("close"))
    wide = rows.select(
        "ticker",
        F.col("_date").try_cast("timestamp").alias("ts"),
        *[F.coalesce(value(c), adjusted).alias(c) for c in ("open", "high", "low")],
        adjusted.alias("close"),
        F.coalesce(value("volume"), F.lit(0.0)).alias("volume"),
    ).filter(F.col("ts").isNotNull())
    return with_history(normalise_ohlcv(wide.dropna(subset=["close"])), at_least)


RESULT_SCHEMA = (
    "date date, portfolio_value double, benchmark_value double, allocations map<string,double>, "
    "confidence double, regime string, optimizer string"
)


def write_results(results: DataFrame, path: str) -> None:
    """Daily results as JSON, one folder per profile."""
    results.write.mode("overwrite").partitionBy("profile").json(path)


def read_results(spark: SparkSession, path: str, array_files: bool = False) -> DataFrame:
    """Daily results from JSON lines, or from files that hold one JSON array each."""
    reader = spark.read.schema(RESULT_SCHEMA + ", profile string").option("multiLine", array_files)
    return reader.json(path)
