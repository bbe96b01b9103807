"""Every registered query against its SQL, on the smallest test tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from colloquy.plans import catalogue, models, records, statistics, texts  # noqa: F401 - register their queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.date() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = db.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.collect()) == want
