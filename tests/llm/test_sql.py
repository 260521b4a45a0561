"""Every query of the subpackage that has SQL gives the SQL's rows on the smallest data set."""

import duckdb
import pytest

from candela.llm.queries import QUERIES, SQL
from tests.test_queries import TABLES
from tests.test_queries import rows_of as comparable


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = QUERIES[name](spark, small).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_all_operators():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
