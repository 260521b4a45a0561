"""Every registered query with SQL gives the SQL's rows on the smallest data set."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("null")
            elif isinstance(v, pd.Timestamp):
                cells.append(str(v.to_datetime64().astype("datetime64[us]")))
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f"{float(v):.9g}")
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, small, con, name):
    got = queries()[name](spark, small).toPandas()
    want = con.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    out = entry(spark).toPandas()
    assert len(out) and {"label", "barrier", "n"} <= set(out.columns)


def test_feature_table(spark, small):
    out = queries()["feature_table"](spark, small)
    names = out.columns
    assert any("adx" in c for c in names) and any(c.startswith("4h_") for c in names) and any(c.endswith("__zscore") for c in names)
    assert not any("smooth" in c and "zscore" in c for c in names)
    assert len(names) == len(set(names)) > 40 and out.count() > 800
    # Columns with more than half of their values missing were dropped.
    filled = out.agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("int")).alias(c) for c in names]).first()
    assert min(filled) >= 0.5
