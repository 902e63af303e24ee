"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from versoflow.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    if (sql := entry.oracle_sql().get(name)) is None:
        return
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
