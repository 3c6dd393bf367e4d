"""Every registered query against its SQL on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, SQL = entry.QUERIES, entry.SQL  # the rest has tests of its own


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kept = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(kept, key=repr)


def alike(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert rows
    if name not in SQL:
        return
    result = duck.execute(SQL[name])
    want_columns, want = canonical([c[0] for c in result.description], result.fetchall())
    assert columns == want_columns
    assert len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want) if not all(map(alike, a, b))]
    assert not wrong, wrong[:3]
