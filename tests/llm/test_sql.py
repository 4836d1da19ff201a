"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest

from sextant.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[columns].convert_dtypes().astype(str).values.tolist()))
    assert rows(got) == rows(want)
