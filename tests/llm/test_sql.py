"""Corpus queries that SQL can express, row by row."""

from pathlib import Path

import duckdb
import pytest

from sparkpanel.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path("/root/testdata/sf0.01").glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
