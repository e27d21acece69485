"""Registered queries of the subpackage against their SQL."""

import duckdb
import pytest

from spindrift.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    r = con.execute(queries.SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(x[c] for c in cols) for x in df.collect()), key=repr)
    assert got == sorted(r.fetchall(), key=repr)
