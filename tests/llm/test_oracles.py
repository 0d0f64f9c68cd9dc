"""Each operator query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from hypsoline.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    made = db.execute(queries.ORACLES[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(df.columns)
    rows = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in made.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in df.collect())
