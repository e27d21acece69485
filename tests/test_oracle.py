"""Every registered query of the engine with SQL equals it on the smallest data."""

import math
import os

import duckdb
import pytest

from spindrift.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, float):
        return round(x, 6)
    return x if isinstance(x, (int, str)) else str(x)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<bigint>": "BIGINT[]", "array<int>": "INTEGER[]"}


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.SQL:
        r = duck.execute(registry.SQL[name])
        kinds = {c[0]: str(c[1]) for c in duck.execute("DESCRIBE " + registry.SQL[name]).fetchall()}
        assert {c: KINDS[k] for c, k in df.dtypes} == kinds
        r = duck.execute(registry.SQL[name])
        assert got == table([c[0] for c in r.description], r.fetchall())
    else:
        assert got[1]
