"""Every registered query of the engine against its SQL on DuckDB, and row counts of the rest."""

import math

import duckdb
import pytest

from chronoweft.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert df.columns and rows
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(repr(tuple(plain(r[n]) for n in order)) for r in rows)
    b = sorted(repr(tuple(plain(r[names.index(n)]) for n in order)) for r in want)
    assert a == b
