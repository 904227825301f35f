"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = db.execute(entry.oracle_sql()[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == columns
    want = sorted((tuple(plain(r[own.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_rest_runs_without_sql(spark):
    found = entry.queries()
    for name in sorted(set(found) - set(entry.oracle_sql())):
        if not name.startswith("op") and name != "pipeline":
            assert found[name](spark, SMALL).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 64
