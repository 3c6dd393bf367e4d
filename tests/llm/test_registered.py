"""Registered queries: against their SQL, or at least a row for each row of their table."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from riskspark.llm.queries import QUERIES, SQL  # noqa: E402
from test_queries import alike, canonical  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = {"op1": "conversations", "op8": "pages"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert len(rows) == duck.execute(f"SELECT count(*) FROM {TABLES.get(name.split('_')[0], 'documents')}").fetchone()[0]
        return
    result = duck.execute(SQL[name])
    want_columns, want = canonical([c[0] for c in result.description], result.fetchall())
    assert columns == want_columns and len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want) if not all(map(alike, a, b))]
    assert not wrong, wrong[:3]


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
