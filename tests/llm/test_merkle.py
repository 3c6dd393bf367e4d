"""The manifest against a plain Merkle tree, with tampering, odd rows and other strides."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskspark.llm import merkle, queries


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """doc_id, leaf, subroot, root, digest of the proof, root from a row that may be changed, for rows of five fields."""
    leaf = lambda r: joined(*map(field, r))
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    trees = [levels([leaf(r) for r in group]) for group in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (group, tree) in enumerate(zip(groups, trees)):
        for i, row in enumerate(group):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            held, siblings = leaf((*row[:3], row[3] + 1, row[4]) if hit else row), []
            for side, j in ((tree, i), (top, k)):
                for level in side[:-1]:
                    sibling = level[j ^ 1] if j ^ 1 < len(level) else ""
                    siblings.append(sibling)
                    held = joined(sibling, held) if j % 2 else joined(held, sibling)
                    j //= 2
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0], joined(*siblings), held, held == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def run(spark, rows, tmp_path, name):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, f"{tmp_path}/{name}")
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def odd_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["web", None, ""]), rng.choice(["en"] * 9 + ["de", None, "", "é", "Z"]), rng.choice([None, i]), "t" * (i % 40)) for i in range(900)]
    rows += [(5, "web", "en", 1, None)] * 3 + [(None, None, None, None, None)] * 2 + [(6, "other", "en", 2, "same id"), (10**6, "x", "alone", 3, "ü" * 50_000)]
    return rows


def test_equals_a_plain_tree(spark, tmp_path):
    rows = odd_rows()
    got = run(spark, rows, tmp_path, "odd")
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513])
def test_sizes_around_a_subtree(spark, tmp_path, n):
    rows = [(i, "s", "en", i, str(i)) for i in range(n)]
    assert run(spark, rows, tmp_path, f"n{n}") == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path, "none") == []


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_the_stride_does_not_matter(spark, tmp_path, stride):
    rows = odd_rows()[:120]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("Text"), F.lit("x").alias("proof"), F.lit(1).alias("_row"))
    made = merkle.manifest(docs, fields=["doc_id", "source", "lang", "n_chars", "text"], stride=stride)
    folded = merkle.fold(F.col("leaf"), F.col("proof"), F.col("top_proof"))
    got = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof"), F.col("top_proof")).alias("p"), folded.alias("f")).collect()
    assert sorted(map(tuple, (r[:5] for r in got)), key=str) == [r[:5] for r in brute(rows)]
    assert all(r.f == r.root for r in got)


def test_a_proof_of_another_row_does_not_fold_to_the_root(spark):
    docs = spark.createDataFrame([(i, "g") for i in range(40)], "doc_id long, lang string")
    made = merkle.manifest(docs, claimed={"other": merkle.row_digest([F.col("f0") + 1, F.col("f1")])})
    wrong = made.filter(merkle.fold(F.col("other"), F.col("proof"), F.col("top_proof")) == F.col("root"))
    assert made.count() == 40 and wrong.count() == 0


def test_many_ranges_number_a_group_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_RANGE", 50)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "big").otherwise("small").alias("grp"), (F.col("id") % 300).alias("key"), F.lit("d").alias("digest"))
    got = merkle.numbered(rows, ["key", "digest"], "test-ranges").collect()
    for group, size in (("big", 700), ("small", 300)):
        own = sorted((r.place, r.key) for r in got if r.grp == group)
        assert [p for p, _ in own] == list(range(size)) and all(r.size == size for r in got if r.grp == group)
        assert [k for _, k in own] == sorted(k for _, k in own)
