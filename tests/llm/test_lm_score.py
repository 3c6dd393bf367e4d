"""Language-model scores against plain figures and enumerated segmentations."""

import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from riskspark.llm import lm_score

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.001"


def every_segmentation(edges, i=0):
    if i == len(edges):
        return 1.0
    return sum(math.exp(w) * every_segmentation(edges, end) for end, w, _ in edges[i])


def test_forward_adds_all_segmentations():
    own = lm_score.Pieces(PATH)
    for word in ["▁the", "▁thing", "▁a", "▁überall", "▁x漢\U0001f600y", "▁ththing"]:
        edges = own.edges(word, own.initial)
        assert math.isclose(lm_score.forward(edges)[-1], math.log(every_segmentation(edges)), rel_tol=1e-12)


def test_expected_pieces_cover_the_word():
    own = lm_score.Pieces(PATH)
    for word in ["▁the", "▁nothings", "▁día"]:
        counts = [0.0] * own.size
        lm_score.expected_pieces(own.edges(word, own.initial), 3.0, counts)
        names = {i: p for p, i in own.number.items()}
        assert math.isclose(sum(c * len(names[i]) for i, c in enumerate(counts) if c), 3.0 * len(word), rel_tol=1e-9)


def plain(rows):
    """Base figures of (doc_id, text) rows, and the words and ends of training."""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    seen, ends = Counter(), 0
    for i, t in rows:
        if not out(i):
            seen.update(lower(t))
            ends += 1
    total, distinct = sum(seen.values()) + ends, len(seen) + (ends > 0)
    bottom = total + 0.1 * (distinct + 1)
    found = []
    for i, t in rows:
        w = lower(t)
        base = sum(math.log10((seen[x] + 0.1) / bottom) for x in w) + math.log10((ends + 0.1) / bottom)
        found.append((i, out(i), len(w) + 1, sum(seen[x] > 0 for x in w) + (ends > 0), total, base))
    return found, seen, ends


def model_score(seen, ends):
    """One round of expectation and maximisation in plain probabilities, from the library's pieces alone."""
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    every = range(lib.get_piece_size())
    spelled = {int(lib.id_to_piece(i)[1:-1], 16): i for i in every if lib.is_byte(i)}
    usual = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
    number = {lib.id_to_piece(i): i for i in usual}
    longest = max(map(len, number))
    ranked = sorted(usual, key=lambda i: (-lib.get_score(i), i)) + sorted(spelled.values())
    whole = sum(1 / (k + 10) for k in range(len(ranked)))
    first = {i: 1 / (k + 10) / whole for k, i in enumerate(ranked)}

    def arcs(word):
        for i in range(len(word)):
            for j in range(i + 1, min(i + longest, len(word)) + 1):
                if word[i:j] in number:
                    yield i, j, [number[word[i:j]]]
            if word[i] not in number:
                yield i, i + 1, [spelled[b] for b in word[i].encode()]

    def ways(word, p):
        """Sums over the segmentations of each beginning and of each rest of a word."""
        own = [(i, j, ids, math.prod(p[x] for x in ids)) for i, j, ids in arcs(word)]
        before, after = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
        for i, j, _, q in own:  # by the place where they start
            before[j] += before[i] * q
        for i, j, _, q in reversed(own):
            after[i] += q * after[j]
        return own, before, after

    counts = Counter()
    for w, c in seen.items():
        own, before, after = ways("▁" + w.decode(), first)
        for i, j, ids, q in own:
            for x in ids:
                counts[x] += c * before[i] * q * after[j] / before[-1]
    total = sum(counts.values()) + ends + 0.1 * (len(ranked) + 1)
    p = {i: (counts[i] + 0.1) / total for i in ranked}
    assert math.isclose(sum(p.values()) + (ends + 0.1) / total, 1.0, rel_tol=1e-9)
    log10 = lambda w: math.log10(ways("▁" + w.decode(), p)[1][-1])
    return lambda text: sum(map(log10, (text or "").encode().lower().split())) + math.log10((ends + 0.1) / total)


@pytest.mark.parametrize("frequent", [40, lm_score.FREQUENT])
def test_scores_equal_plain_figures(spark, tmp_path, frequent):
    rng = random.Random(3)
    words = ["the", "The", "thing", "überall", "漢字", "x" * 50, "a\x1cb", " ", "end."] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(80)] + [None, "", " \n\t", "the " * 3_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, lp int, Word string").repartition(4).write.parquet(path)
    got = lm_score.score_documents(spark.read.parquet(path), PATH, frequent=frequent).collect()
    want, seen, ends = plain(rows)
    score = model_score(seen, ends)
    order = lambda r: (r[0] is None, r[0] or 0)
    want = sorted([(*w, score(t)) for w, (_, t) in zip(want, rows)], key=order)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=order), want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_words_are_spread_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm_score, "WORDS_PER_TASK", 10)
    spark.range(95).selectExpr("cast(id as string) AS word", "id AS c").coalesce(1).write.parquet(str(tmp_path / "words"))
    spread = lm_score.spread_words(spark.read.parquet(str(tmp_path / "words")))
    assert spread.rdd.getNumPartitions() == 10 and spread.count() == 95


def test_frequent_words_are_whole_classes_of_counts(spark):
    words = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([900, 900, 500, 40, 2, 2, 1, 1, 1])], "word string, n long")
    counts = lambda most: sorted((r.n for r in lm_score.frequent_words(words, most).collect()), reverse=True)
    assert counts(0) == counts(1) == []
    assert counts(2) == [900, 900] and counts(4) == counts(5) == [900, 900, 500, 40]
    assert counts(8) == [900, 900, 500, 40, 2, 2] and len(counts(9)) == 9
    assert lm_score.frequent_words(words.limit(0), 5).count() == 0


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert lm_score.score_documents(spark.read.parquet(path), PATH).collect() == []


def test_training_helps_on_held_out_texts(spark):
    """Trained weights give held-out texts a higher probability than the vocabulary's own scores do."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    got = [r for r in lm_score.score_documents(rows, PATH).collect() if r.held_out]
    own = lm_score.Pieces(PATH)
    texts = {r.doc_id: r.text for r in rows.collect()}
    before = sum(lm_score.forward(own.edges("▁" + w.decode(), own.initial))[-1] for r in got for w in lm_score.words_of(texts[r.doc_id]))
    assert sum(r.score for r in got) > before / math.log(10)
