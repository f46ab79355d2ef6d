"""Each query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_document_meets_the_next(spark):
    """No id is left out."""
    from semblance.queries import QUERIES, doc_features

    ids = {r.fid for r in doc_features(spark, SF).select("fid").distinct().collect()}
    for name, want in (("containment", {k for k in ids if k + 1 in ids}), ("diff_sets", ids)):
        assert {r[0] for r in QUERIES[name](spark, SF).collect()} == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert glob.glob(f"{SF}/*.parquet")
