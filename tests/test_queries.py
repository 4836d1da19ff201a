"""Every retrieval query against its SQL on the smallest tables."""

import duckdb
import pytest

from sextant.plans.oracle import ORACLE
from sextant.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df, columns):
    return sorted(tuple("null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = duck.execute(ORACLE[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
