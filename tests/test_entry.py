"""Every registered query of the index against its SQL twin; small tables."""

import math

import pytest

import __spark_entry__ as entry
from lodestone.plans import queries as plans

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert rows
    if name in plans.SQL:
        got = duck.sql(plans.SQL[name])
        assert sorted(got.columns) == names
        at = [got.columns.index(c) for c in names]
        assert rows == sorted(tuple(plain(r[k]) for k in at) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
