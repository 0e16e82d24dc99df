import os

import duckdb
import pytest

import __spark_entry__
from mergelens.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v):
    return "null" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    mine = sorted(tuple(text(r[c]) for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    theirs = sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["file", "line_start", "rule_id", "severity", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
