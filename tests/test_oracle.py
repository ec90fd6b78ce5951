"""Every registered query against its SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from sparkpanel.plans import registry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def rows_of(names, rows):
    """Rows with columns by name, in the order of their keys and then of their numbers, so that the last digits of a sum don't decide."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: (repr([x for x in r if not isinstance(x, float)]), [f"{x:.7g}" for x in r if isinstance(x, float)]))


def close(a, b):
    """Equal but for the last digits, by which sums in another order may differ."""
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(close(x, y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """What the rows hold is tested in test_invariants.py."""
    assert QUERIES[name](spark, DATA).count() > 0
