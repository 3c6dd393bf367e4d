"""The filtering stages on odd rows: null ids and texts, repeated rows, empty tables, names that clash with their own."""

import pytest
from pyspark.sql import functions as F

from riskspark.llm import decontaminate, line_dedup, near_dedup, quality

LONG = " ".join(f"word{i}" for i in range(60)) + "."
OTHER = " ".join(f"thing{i}" for i in range(80)) + "."
CLASH = ["_row", "_kept", "_gone", "found", "row", "node", "lines", "near", "f", "at", "c0", "kept"]
SCHEMA = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASH)


def rows():
    texts = [(1, LONG), (1, LONG), (2, OTHER), (None, LONG), (None, None), (3, ""), (4, None), (4, None), (5, "short one")]
    return [(i, t, len(t or ""), *[f"{c}-{k}" for c in CLASH]) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    def write(data, name):
        path = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return write


def benchmark(spark):
    return spark.createDataFrame([("a", OTHER), ("b", None), (None, "")], "item_id string, text string")


STAGES = {
    "quality": (lambda df: quality.keep_good(df), [0, 1, 2, 3]),
    "lines": (lambda df: line_dedup.drop_repeated_lines(df), [2, 3, 4, 5, 6, 7, 8]),
    "near": (lambda df: near_dedup.keep_one(df), [2, 3, 4, 5, 6, 7, 8]),
    "clean": (lambda df: decontaminate.keep_clean(df, benchmark(df.sparkSession)), [0, 1, 3, 4, 5, 6, 7, 8]),
}


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_odd_rows_keep_all_columns(written, stage):
    work, stay = STAGES[stage]
    docs = written(rows(), stage)
    got = work(docs)
    assert got.columns == docs.columns
    assert sorted(got.collect(), key=str) == sorted((tuple(rows()[k]) for k in stay), key=str)


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_empty_table(written, stage):
    docs = written([], f"none-{stage}")
    got = STAGES[stage][0](docs)
    assert got.columns == docs.columns and got.count() == 0


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_columns_that_differ_by_case_alone(spark, written, stage):
    docs = written(rows(), f"case-{stage}").select("*", F.lit("upper").alias("Text"), F.lit(7).alias("DOC_ID"))
    got = STAGES[stage][0](docs)
    assert got.columns == docs.columns
    assert sorted(r[1] or "" for r in got.collect()) == sorted(rows()[k][1] or "" for k in STAGES[stage][1])
    assert {r[-2:] for r in map(tuple, got.collect())} == {("upper", 7)}
