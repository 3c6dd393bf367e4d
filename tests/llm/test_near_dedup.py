"""Near-duplicate classes against all pairs compared."""

import random
import re

import numpy as np
import pytest

from riskspark.llm import near_dedup

SF_DIR = "/root/testdata/sf0.01"


def plain_shingles(text):
    """Runs of five words (of fewer, all of them) as tuples; words have no ASCII white space, and A-Z in lower case."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def brute_classes(texts, threshold=0.8):
    """A class number of each text: chains of pairs whose shingle sets are alike; none for texts without words."""
    sets = [plain_shingles(t) for t in texts]
    by_shingle = {}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(sets):
        met = {j for s in own for j in by_shingle.get(s, ())}
        for j in met:
            common = len(own & sets[j])
            if common >= threshold * (len(own) + len(sets[j]) - common):
                parent[find(i)] = find(j)
        for s in own:
            by_shingle.setdefault(s, []).append(i)
    return [find(i) for i in range(len(texts))]


def check(docs, rows):
    """rows: (doc_id, text); docs: the same as a scan."""
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    want = {}
    for (doc, _), c in zip(rows, brute_classes([t for _, t in rows])):
        want.setdefault(c, []).append(doc)
    order = lambda d: (d is not None, d or 0)
    classes = sorted((sorted(c, key=order) for c in want.values()), key=lambda c: list(map(order, c)))
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(map(order, kept)) == sorted(order(c[0]) for c in classes)
    assert sorted((order(r.doc_id), order(r.class_id)) for r in got) == sorted((order(d), order(c[0])) for c in classes for d in c)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_large_group_and_odd_cases(spark, tmp_path):
    """A chain of near copies that drifts away from its start, a crowd of near copies, copies, short and empty texts."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, chain = [], fresh(120)
    for i in range(40):
        texts.append(" ".join(chain))
        chain[3 * i] = "changed"
    base = fresh(300)
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(300), rng.choice([1, 2, 5, 6, 7, 12])):
            own[at] = "edit" + str(rng.randrange(9))
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 30 + ["one two", "One  two", "one two three", "word " * 5_000, "word " * 7_000]
    rows = list(enumerate(texts)) + [(5, texts[5]), (9_000, None), (9_001, ""), (9_002, " \n"), (None, "null id " + texts[60])]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, row int, Bands string").repartition(5).write.parquet(path)
    check(spark.read.parquet(path), rows)


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert near_dedup.classes(spark.read.parquet(path)).collect() == []


def test_keep_one_keeps_columns(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "other words are here now", "z"), (4, None, "n")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    assert sorted(map(tuple, near_dedup.keep_one(spark.read.parquet(path)).collect())) == [rows[1], rows[2], rows[3]]


@pytest.mark.parametrize("likeness", [0.3, 0.5, 0.8])
def test_signatures_follow_similarity(likeness):
    n = 2000
    moved = round(n * (1 - likeness) / (1 + likeness))
    a, b = np.arange(n), np.arange(moved, n + moved)
    elements = near_dedup.mix(np.concatenate((a, b)).astype(np.uint64))
    made = near_dedup.dart_signatures(np.repeat([0, 1], n), elements, np.ones(2 * n), 2, 4096)
    assert abs((made[0] == made[1]).mean() - (n - moved) / (n + moved)) < 0.04


def test_weighted_signatures():
    weights = np.array([3.0, 1.5, 0.5, 2.0, 1.5, 1.0])
    elements = near_dedup.mix(np.array([1, 2, 3, 1, 2, 3], np.uint64))
    made = near_dedup.dart_signatures(np.array([0, 0, 0, 1, 1, 1]), elements, weights, 2, 8192)
    assert abs((made[0] == made[1]).mean() - (2 + 1.5 + 0.5) / (3 + 1.5 + 1)) < 0.04
