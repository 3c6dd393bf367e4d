"""Line deduplication against all pairs of lines compared."""

import random

import pytest
from pyspark.sql import functions as F

from riskspark.llm import line_dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutated(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("XYé\U0001f600"))
        elif at < len(out):
            out[at : at + 1] = [] if kind == 1 else [rng.choice("XYé\U0001f600")]
    return "".join(out)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_automaton_equals_edit_distance(spark, k):
    rng = random.Random(k)
    pairs = [("", ""), ("", "a"), ("ab", ""), ("abc", "abc"), ("a" * 70, "a" * 69)]
    for _ in range(200):
        a = "".join(rng.choices("abé", k=rng.randrange(30)))
        pairs.append((a, mutated(rng, a, rng.randrange(k + 3))))
    df = spark.createDataFrame([(a, b, list(a), list("<" + b)) for a, b in pairs], "a string, b string, ca array<string>, cb array<string>")
    sizes = F.size("ca"), F.size("cb") - 1
    near = line_dedup.within_edits(F.col("ca"), F.col("cb"), k, F.lit(0), sizes[0], F.lit(1), sizes[1])
    df = df.select("a", "b", near.alias("near"))
    for r in df.collect():
        assert r.near == (edits(r.a, r.b) <= k), (r.a, r.b)


def brute(rows, k, least, every_line=False):
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    places = sorted(((doc, row, pos, line) for row, (doc, text) in enumerate(rows) if text is not None for pos, line in enumerate(text.split("\n"))), key=order)
    seen, gone = {}, set()
    for doc, row, pos, line in places:
        if len(line) < least:
            if every_line and line.strip(" \t\n\v\f\r"):
                if line in seen:
                    gone.add((row, pos))
                seen[line] = True
            continue
        if line in seen or any(len(x) >= least and abs(len(line) - len(x)) <= k and edits(line, x) <= k for x in seen):
            gone.add((row, pos))
        seen[line] = True
    out = []
    for row, (doc, text) in enumerate(rows):
        lines = [] if text is None else text.split("\n")
        kept = [x for pos, x in enumerate(lines) if (row, pos) not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("crowded", [line_dedup.CROWDED, 10])
def test_lines_equal_brute_force(spark, tmp_path, monkeypatch, k, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    rng = random.Random(17)
    fresh = lambda n: "".join(rng.choices("abcdef gé", k=n))
    base = [fresh(rng.randrange(20, 60)) for _ in range(14)]
    texts = [None, "", "\n\n", "short\nshort", "x" * 20, "x" * 21]
    for _ in range(30):
        texts.append("\n".join(mutated(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randrange(6))))
    crowd = base[0] + base[1]
    texts += ["\n".join(crowd[:at] + c + crowd[at + 1 :] for at in rng.sample(range(len(crowd)), 3)) for c in "QRSTUVW"]
    rows = list(enumerate(texts)) + [(9, texts[9]), (None, texts[10])]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, 3, "p") for i, t in rows], "doc_id long, text string, row int, Line string").coalesce(1).write.parquet(path)
    got = line_dedup.without_repeated_lines(spark.read.parquet(path), max_edits=k).drop("row").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3] or "")
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, k, line_dedup.MIN_CHARS), key=key)


def test_emptied_documents_go(spark, tmp_path):
    path = str(tmp_path / "docs")
    line = "a line that is long enough"
    rows = [(1, f"{line}\nmore", "x"), (2, line, "y"), (3, None, "z"), (4, line + "s\n ", "w"), (5, "", "v")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    got = line_dedup.drop_repeated_lines(spark.read.parquet(path))
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 5]


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert line_dedup.without_repeated_lines(spark.read.parquet(path)).collect() == []


def test_copies_with_a_short_line_leave_no_stub(spark, tmp_path):
    path = str(tmp_path / "docs")
    text = "a line that is long enough\nshort\n \nanother line that is long enough\nshory"
    rows = [(1, text), (2, text), (3, "short\n\n \na line that stands here alone"), (4, "shor")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs, every_line=True).collect()}
    assert got == {1: text, 3: "\n \na line that stands here alone", 4: "shor"}
    removed = {r.doc_id: r.n_removed for r in line_dedup.without_repeated_lines(docs, every_line=True).collect()}
    assert removed == {1: 0, 2: 4, 3: 1, 4: 0}
