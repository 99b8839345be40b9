"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from driftwood.plans import bindings

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    got = __spark_entry__.queries()[name](spark, FOLDER)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted([plain(r[x]) for x in cols] for r in got.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())
