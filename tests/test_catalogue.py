"""Every registered query runs at the smallest scale, and equals its SQL where it has some."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(names, found):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(x, 9) if isinstance(x, float) else x

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(c[0] for c in want.description)
    assert got == rows([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
