"""Every query with SQL gives the rows that DuckDB gives, over the smallest tables."""

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return ("nan" if v != v else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["sid", "day_no"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(__spark_entry__.queries()))
def test_query(spark, db, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect()) if name not in ("p7_ids",) else df.count()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        out = db.sql(sql)
        assert sorted(out.columns) == cols
        at = [out.columns.index(c) for c in cols]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in out.fetchall())
