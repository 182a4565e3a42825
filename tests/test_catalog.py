"""Every query with SQL against that SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from gleanframe import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, datetime.datetime) and x.tzinfo is None and x.time() == datetime.time():
        return x.date()
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    mine, theirs = rows(df.columns, df.collect()), rows(names, want.fetchall())
    assert mine == theirs and (mine or name in ("j9_package_links",))
