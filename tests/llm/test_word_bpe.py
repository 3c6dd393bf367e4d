"""Word BPE against the library, whole tables and odd texts, and the segment tree against plain merging."""

import random

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    None,
    "",
    " \n\t",
    "a",
    "a" * 20_000,
    "xyz" * 4_000 + " " * 500 + "!?" * 3_000,
    "Hello, world! It's 2024's <|endoftext|> and <|startoftext|><|endoftext|>.",
    "<|ENDOFTEXT|> İstanbul ΑΣ ΑΣ. ǅ ß ﬁ é é Å Ω क्षि 漢字かな 👩‍👩‍👧 \x1c\x85\xa0　 end",
    "don't DON'T we'll 'S 's '' ''s",
    "\x00\x01 nul",
]


def library():
    return Tokenizer.from_file(PATH)


def expected(own, text):
    ids = own.encode(text or "", add_special_tokens=False).ids
    return ids, own.decode(ids, skip_special_tokens=False)


def test_odd_texts_equal_the_library(spark):
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choices("abcXYZ 012 \n\t.,;'-_<|>[]éßñ漢あ́  ", k=rng.randrange(300))) for _ in range(40)]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(3, "a", "x", 7), (None, "null id", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Ids string, decoded int").repartition(3)
    got = word_bpe.round_trip(docs, PATH)
    assert got.columns == ["doc_id", "ids", "decoded"]
    own = library()
    want = sorted((i is None, i or 0, *expected(own, t)) for i, t, *_ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in got.collect()) == want
    assert word_bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_a_whole_table_equals_the_library(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r.doc_id: (r.ids, r.decoded) for r in word_bpe.round_trip(spark.read.parquet(path), PATH).collect()}
    own = library()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall()
    assert len(rows) == len(got)
    assert all(got[i] == expected(own, t) for i, t in rows)


def test_segment_tree_equals_plain_merging():
    own = word_bpe.WordBpe(PATH)
    rng = random.Random(2)
    for size in [1, 2, 3, 4, 5, 8, 9, 33, 100] * 20:
        word = "".join(rng.choices("thereandingaé", k=size))
        data = word.encode()
        parts = [own.inner[b] for b in data[:-1]] + [own.last[data[-1]]]
        while True:
            found = [(own.merges.get(a << word_bpe.ID_BITS | b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, i = min(found, default=(1 << 60, 0))
            if best == 1 << 60:
                break
            parts[i : i + 2] = [best & (1 << word_bpe.ID_BITS) - 1]
        assert own.ids(word) == parts


def test_cache_is_bounded_by_bytes(monkeypatch):
    own = word_bpe.WordBpe(PATH)
    monkeypatch.setattr(word_bpe, "CACHED_BYTES", 2_000)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    for word in words:
        assert own[word] == own[word]
        assert len(own) <= 12
    assert own["x" * 100] and "x" * 100 not in own


def test_plan_has_one_python_step_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = word_bpe.round_trip(docs, PATH).select("doc_id", F.size("ids"), "decoded")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
