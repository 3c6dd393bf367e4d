"""Operators of one pass over the texts: against libraries and plain brute force, with the odd cases."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm import byte_bpe, decontaminate, pretokens, quality, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    None,
    "",
    " ",
    "\n\n\t",
    "a",
    "a" * 20_000,
    "ab" * 5_000 + " " * 3_000 + "x",
    "Hello, world! It's 2024's <|endoftext|> and <|startoftext|>.",
    "<|ENDOFTEXT|> İstanbul ΑΣ ΑΣ. ǅ ß ﬁ é é Å Ω क्षि 漢字かな 👩‍👩‍👧 \x1c\x1d\x85\xa0　 end",
    "don't DON'T we'll 'S 's '' ''s",
    "\x00\x01 nul",
]


def odd_rows():
    rng = random.Random(5)
    marks = "abcXYZ 012 \n\t.,;'-_<|>[]éßñ漢あ́  "
    texts = ODD + ["".join(rng.choices(marks, k=rng.randrange(400))) for _ in range(60)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return rows + rows[5:8] + [(None, "null id", "y", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, and columns that clash with results of the operators."""
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, Found string, n_words int").repartition(3)


def by_id(df, *columns):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), *[r[c] for c in columns]) for r in df.collect())


def wanted(figure):
    return sorted(((i is None, i or 0), *figure(t or "")) for i, t, *_ in odd_rows())


def test_byte_bpe_equals_the_library(odd):
    ranks = byte_bpe.read_ranks(BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def figure(text):
        ids = library.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes(), text.encode()

    got = by_id(byte_bpe.round_trip(odd, BPE, public_tokenizers.PATTERN), "ids", "decoded")
    assert [(k, bytes(a), bytes(b)) for k, a, b in got] == wanted(figure)


def test_rank_queue_equals_plain_merging():
    ranks = byte_bpe.read_ranks(BPE)
    rng = random.Random(3)
    for size in [2, 3, 5, 9, 17, 60] * 30:
        piece = bytes(rng.choices(b"thereandinga  ", k=size))
        parts = [piece[i : i + 1] for i in range(size)]
        while len(parts) > 1:
            pairs = [(ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(pairs)
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert byte_bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_token_counts_equal_the_library(odd):
    library = Tokenizer.from_file(WORD_BPE)
    want = wanted(lambda t: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)))
    assert by_id(token_counts.count_tokens(odd, WORD_BPE), "n_bytes", "n_tokens") == want


def test_frequent_pre_tokens_are_those_of_all_documents(spark):
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:04}") for i in range(2500)]
    texts = [f"same {name} same" for name in names] + [None, "", "w" * 65]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    library = Tokenizer.from_file(WORD_BPE)
    size = lambda w: len(library.encode(w, add_special_tokens=False).ids)
    assert token_counts.frequent_lengths(docs, WORD_BPE) == {w: size(w) for w in ["same", *names]}
    assert token_counts.frequent_lengths(docs, WORD_BPE, most=3) == {w: size(w) for w in ["same", *names[:2]]}


def test_summaries_keep_every_frequent_pre_token(spark):
    rng = random.Random(4)
    spell = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05}")
    words = [spell(min(int(rng.paretovariate(0.7)), 99_999)) for _ in range(30_000)]
    exact = Counter(words)
    docs = spark.createDataFrame([(" ".join(words[i : i + 300]),) for i in range(0, len(words), 300)], "text string").repartition(23)
    counters = 100
    made = token_counts.task_summaries(docs, WORD_BPE, counters)
    assert made.count() == 23 and all(len(r.words) <= counters for r in made.collect())
    for merged in (2, 5, 16):
        (row,) = token_counts.merge_summaries(made, counters, merged).collect()
        held = dict(zip(row.words, row.ns))
        assert len(held) <= counters
        for word, n in exact.items():
            assert n - len(words) / (counters + 1) <= held.get(word, 0) <= n
    few = spark.createDataFrame([], "text string")
    assert token_counts.frequent_lengths(few, WORD_BPE) == {}


def test_counts_do_not_depend_on_the_frequent_table(odd, monkeypatch):
    want = by_id(token_counts.count_tokens(odd, WORD_BPE), "n_bytes", "n_tokens")
    monkeypatch.setattr(token_counts, "frequent_lengths", lambda texts, path: {})
    assert by_id(token_counts.count_tokens(odd, WORD_BPE), "n_bytes", "n_tokens") == want


def test_plain_texts_normalize_like_the_library():
    own = token_counts.Lengths(WORD_BPE)
    for start in range(0, 0x250, 8):
        text = "".join(f"a{chr(c)}B" for c in range(start, start + 8))
        assert pretokens.is_plain(text)
        want = token_counts.PRE_TOKEN.full(own.tokenizer.normalizer.normalize_str(text))
        assert own.words(text) == want


def test_plain_patterns_split_alike():
    rng = random.Random(12)
    every = [chr(c) for c in range(0x250)] + [chr(c) for c in (*range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))]
    for pattern in (public_tokenizers.PATTERN, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        split = pretokens.Splitter(pattern)
        for _ in range(300):
            text = "".join(rng.choices(every + list("  aabb11''\n\n..stmvl") * 20, k=80))
            assert pretokens.is_plain(text) and split.plain(text) == split.full(text)


def test_token_counts_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, WORD_BPE).collect() == []
    assert byte_bpe.round_trip(empty, BPE, public_tokenizers.PATTERN).collect() == []


def brute_windows(texts, items, k=13):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - k + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 6_000])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(11)
    vocabulary = ["the", "of", "Ab", "cé", "x1", "日本", "longerwordhere", "q"]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, some(rng.randrange(1, 40))) for i in range(25)] + [(None, some(20)), (7, None), (90, " ... "), (91, "zz"), (92, "one two")]
    items += items[:2]
    texts = [None, "", "!!", "zz", "ZZ-top", "a zz zz one, two"] + [some(rng.randrange(300)) for _ in range(40)]
    texts += [some(30) + " " + (t or "") + "\n" + some(5) for _, t in items[:12]] + [some(9) * 4_000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[30])], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    found = decontaminate.search(docs, bench, block_bytes=block_bytes)
    f = F.col("found")
    got = found.select("doc_id", "found.*", decontaminate.hit_words(f).alias("n"), decontaminate.is_contaminated(f).alias("bad")).collect()
    want = brute_windows(texts + [texts[30]], items)
    for r in got:
        assert (r.n_words, r.n, r["items"], r.bad) == want[len(texts) if r.doc_id is None else r.doc_id]
    assert len(got) == len(want)


def test_decontamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "some words", 5)], "doc_id long, text string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (2, 0, [], False)
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


def brute_repeats(words):
    n = len(words)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def test_suffix_repeats_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        words = rng.choices(range(rng.randrange(1, 12)), k=rng.randrange(1, 60))
        names = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.array([names[w] for w in words] + [len(names)])
        assert quality.suffix_repeats(ids).tolist() == brute_repeats(words) + [0]


def test_quality_figures(odd, spark):
    def figure(text):
        w = re.findall("[^\x20\x09-\x0d]+", text)
        longest = brute_repeats(w) if len(w) < 500 else None
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        inside = lambda k: len({p for i, m in enumerate(longest) if m >= k for p in range(i, i + (3 if k == 3 else m))})
        return len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), inside(3), inside(8)

    got = by_id(quality.quality(odd), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words")
    assert got == wanted(figure)
    assert quality.quality(odd.limit(0)).collect() == []


def test_quality_verdict(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    part = fresh(210)
    rows = [("clean", fresh(300)), ("short", fresh(49)), ("long repeat", part + " " + fresh(900) + " " + part), ("covered", (fresh(9) + "\n") * 3 + "\n".join([fresh(9)] * 30))]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert kept == {"clean": True, "short": False, "long repeat": False, "covered": False}
    assert {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id string, text string")).collect()} == {"clean"}


def test_ranks_file():
    line = open(BPE, "rb").readline().split()
    assert byte_bpe.read_ranks(BPE)[base64.b64decode(line[0])] == int(line[1])
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
