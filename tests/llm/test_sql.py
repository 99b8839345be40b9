"""The numbered queries that have SQL give the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from driftwood.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted([str(r[x]) for x in cols] for r in got.collect()) == sorted([str(r[i]) for i in at] for r in want.fetchall())
