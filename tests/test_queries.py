"""Every registered query against its SQL twin, on the smallest driver table set."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from casewright.plans import all_queries, all_sql

SF = os.environ.get("CASEWRIGHT_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.4f}".replace("-0.0000", "0.0000")
    if hasattr(v, "quantize"):
        return f"{float(v):.4f}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_sql(name, spark, duck):
    got = all_queries()[name](spark, SF)
    want = duck.execute(all_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_runs(name, spark):
    assert all_queries()[name](spark, SF).collect() is not None
