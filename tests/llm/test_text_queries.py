"""The registered text queries beside their SQL, over whole small tables."""

import duckdb
import pytest

from barcast.llm.queries import registered
from barcast.llm.sql import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(oracle()[name])
    columns = [d[0] for d in want.description]
    got = registered()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.fetchall()))
