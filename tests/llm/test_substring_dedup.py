"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from riskspark.llm import substring_dedup

SF_DIR = "/root/testdata/sf0.01"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(d[i : i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), kept))
    return out


def check(docs, rows, length):
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_dedup.remove_repeats(docs, length=length).collect()), key=order)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], length))), key=order)
    assert got == want


def scan(spark, path, rows):
    spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id long, text string, row int, Spot int").repartition(4).write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("length", [200, 60])
def test_odd_texts(spark, tmp_path, length):
    rng = random.Random(length)
    fresh = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    passage = fresh(length + 40)
    texts = [None, "", "x", "a" * (3 * length), "ab" * length, fresh(length), fresh(length - 1)]
    for _ in range(40):  # a passage, whole or cut to about one string, in fresh surroundings
        cut = rng.randrange(60)
        texts.append(fresh(rng.randrange(400)) + passage[cut : cut + length + rng.randrange(-3, 4)] + fresh(rng.randrange(300)))
    base = fresh(1500)
    for _ in range(25):  # near copies
        own = list(base)
        for at in rng.sample(range(1500), rng.randrange(9)):
            own[at] = rng.choice("XYZ")
        texts.append("".join(own))
    texts += [base] * 6 + [fresh(50) + base[100 : 100 + length] + fresh(30) + base[100 : 100 + length] + fresh(9)]
    rows = list(enumerate(texts)) + [(2, texts[20]), (None, texts[30])]
    check(scan(spark, tmp_path / "docs", rows), rows, length)


def test_long_texts_are_cut_into_segments(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 500)
    text = "".join(rng.choices("abcdefgh ", k=6_000))
    texts = [text[:3_000].encode(), (text[700:2_300] + "zz" + text[2_200:]).encode()]
    for part, at in zip(texts, (0, 0)):
        cells = substring_dedup.anchor_cells([part], 200, 100)
        covered = set()
        for a, f, l in zip(cells["anchor"], cells["first"], cells["last"]):
            covered.update(range(a - l, a - f + 1))
        assert covered == set(range(at, len(part) - 199))
    segments = [x for block in substring_dedup._segments(iter([(7, text)]), 200) for x in block]
    assert len(segments) > 5
    assert {p for _, at, d in segments for p in range(at, at + len(d) - 199)} == set(range(len(text) - 199))


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 200)


def test_no_documents(spark, tmp_path):
    assert substring_dedup.remove_repeats(scan(spark, tmp_path / "none", [])).collect() == []
