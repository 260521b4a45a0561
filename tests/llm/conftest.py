import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def frame(spark):
    """A table from rows and a schema, spread over some partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def rows_of():
    def rows(df, *columns):
        found = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in found.collect()), key=repr)

    return rows


@pytest.fixture(scope="session")
def odd_documents(frame):
    """Null, empty, blank and very long texts, repeated rows, null keys, and columns named like results."""
    long_text = " ".join(f"word{k % 977} und{k % 31}" for k in range(40_000))
    rows = [
        (1, None, "en", "a", "x"), (2, "", "en", "a", "x"), (3, " \n\t ", "de", None, None), (4, "The end of it all is near.", None, "b", "x"),
        (4, "The end of it all is near.", None, "b", "x"), (None, "The end of it all is near.", "en", "b", "x"),
        (5, long_text, "en", "b", "y"), (6, "!!! ###", None, None, "y"), (7, "Stra\u00dfe \U0001f600 fin", "de", "c", None),
    ]
    df = frame(rows, "doc_id long, text string, lang string, source string, score string")
    for name in ("host", "fingerprint", "n_words", "block", "group", "rejected", "found", "body"):
        df = df.withColumn(name, F.lit("kept?"))
    return df
