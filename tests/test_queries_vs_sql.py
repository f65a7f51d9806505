"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from orderloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=2e-5, abs_tol=2e-5) or (a != a and b != b)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    order = lambda rows: sorted(rows, key=lambda r: [(x is not None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r])
    got = order([tuple(r[c] for c in cols) for r in df.collect()])
    at = [want.columns.index(c) for c in cols]
    rows = order([tuple(r[i] for i in at) for r in want.fetchall()])
    assert len(got) == len(rows)
    assert all(close(a, b) for g, w in zip(got, rows, strict=True) for a, b in zip(g, w, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
