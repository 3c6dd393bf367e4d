"""Language-model scores by subword lattice likelihood.

The model is a unigram model over the pieces of an existing vocabulary and one end piece. A word (with the vocabulary's
word mark before it) has a lattice of all its segmentations into pieces; the forward recursion adds their
probabilities in log space, and a text's probability is the product over its words and its end. So the score is the
marginal over all segmentations, not that of the best one.

Piece weights start from the vocabulary's own scores (its merge order, as a Zipf law) and are trained on the corpus by
one step of expectation and maximisation: every distinct word of the training texts is segmented in all ways, weighted,
and counted as often as it occurs there. Characters outside the vocabulary are spelled by its byte pieces.

Words are counted over all documents before anything is shuffled, per-word figures are made once per distinct word, and
texts get them in two ways: the FREQUENT most frequent words from a broadcast table of bounded size, all others by a
join on the word. So a word that a third of all texts hold is never a join key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import pick, small_batches, stored, with_row_id

FREQUENT = 200_000  # most words broadcast with their figures
FLUSH_WORDS = 300_000  # distinct words a task counts before it hands them on
WORDS_PER_TASK = 100_000  # distinct words whose lattices one task walks, some seconds of work
CLASSES = 64  # classes of word counts to a factor of e
SMOOTHING = 0.1
MARK = "▁"
_LOG10 = math.log(10)

_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """A vocabulary: numbers of its pieces and of its byte pieces, and the beginnings of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.number: dict[str, int] = {}
        self.bytes: list[int] = [0] * 256
        scores: dict[int, float] = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.number[piece] = i
                scores[i] = model.get_score(i)
        # Beginnings of pieces, with the number of the piece that they are, or -1.
        self.known = {p[:k]: -1 for p in self.number for k in range(1, len(p))} | self.number
        self.alone = [(i,) for i in range(self.size)]
        # Scores fall with the merge order; bytes come last.
        order = sorted(scores, key=lambda i: (-scores[i], i)) + sorted(set(self.bytes))
        self.initial = [-math.inf] * self.size
        total = math.log(sum(1 / (k + 10) for k in range(len(order))))
        for k, i in enumerate(order):
            self.initial[i] = -math.log(k + 10) - total

    def edges(self, word: str, weights: list[float]) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place of a word: (end, log weight, pieces) of what may start there."""
        known, alone = self.known.get, self.alone
        n = len(word)
        out = []
        for i in range(n):
            own = []
            for j in range(i + 1, n + 1):
                piece = known(word[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    own.append((j, weights[piece], alone[piece]))
            if not own or own[0][0] > i + 1:  # no piece is this character
                spelled = tuple(self.bytes[b] for b in word[i].encode())
                own.append((i + 1, sum(weights[p] for p in spelled), spelled))
            out.append(own)
        return out


def pieces(path: str) -> Pieces:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    if len(terms) == 2:
        a, b = terms
        return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms]))


def forward(edges: list[list[tuple[int, float, tuple[int, ...]]]]) -> list[float]:
    """Log probability of all ways to reach each place; the last is the word's marginal."""
    arriving: list[list[float]] = [[] for _ in range(len(edges) + 1)]
    arriving[0].append(0.0)
    alpha = []
    for own, terms in zip(edges, arriving):
        a = terms[0] if len(terms) == 1 else _log_sum(terms)
        alpha.append(a)
        for end, weight, _ in own:
            arriving[end].append(a + weight)
    alpha.append(_log_sum(arriving[-1]))
    return alpha


def expected_pieces(edges: list[list[tuple[int, float, tuple[int, ...]]]], times: float, counts: list[float]) -> None:
    """Add the expected number of each piece in a word that occurs `times` times."""
    n = len(edges)
    exp = math.exp
    alpha = forward(edges)
    beta = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        own = edges[i]
        beta[i] = own[0][1] + beta[own[0][0]] if len(own) == 1 else _log_sum([weight + beta[end] for end, weight, _ in own])
    total = alpha[n]
    for i, own in enumerate(edges):
        start = alpha[i] - total
        for end, weight, held in own:
            share = times * exp(start + weight + beta[end])
            for piece in held:
                counts[piece] += share


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def count_words(rows: DataFrame) -> DataFrame:
    """word, c (in training texts) and n (in all) over all rows of (text, held_out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            words = list(every)
            total = [every[w] for w in words]
            trained = [n - held[w] for n, w in zip(total, words)]
            every.clear()
            held.clear()
            return pa.record_batch({"word": pa.array(words, pa.binary()), "c": pa.array(trained, pa.int64()), "n": pa.array(total, pa.int64())})

        for batch in batches:
            for text, out in zip(batch.column("text"), batch.column("held_out").to_pylist()):
                words = words_of(text.as_py())
                every.update(words)
                if out:
                    held.update(words)
                if len(every) >= FLUSH_WORDS:
                    yield made()
        yield made()

    return rows.select("text", "held_out").mapInArrow(count, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def spread_words(words: DataFrame) -> DataFrame:
    """words dealt by hash over tasks of about WORDS_PER_TASK; read as stored, the small table makes few tasks of much work."""
    return words.repartition(max(1, math.ceil(words.count() / WORDS_PER_TASK)), "word")


def fit_weights(words: DataFrame, ends: int, path: str) -> tuple[list[float], float]:
    """Log weights of all pieces and of the end, from words (word, c) and the number of training texts."""
    vocabulary = pieces(path)
    start = words.sparkSession.sparkContext.broadcast(vocabulary.initial)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        counts = [0.0] * own.size
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                expected_pieces(own.edges(MARK + word.decode(), start.value), c, counts)
        used = [i for i, x in enumerate(counts) if x]
        yield pa.record_batch({"piece": pa.array(used, pa.int32()), "expected": pa.array([counts[i] for i in used], pa.float64())})

    found = words.filter("c > 0").select("word", "c").mapInArrow(expect, "piece int, expected double")
    # A row for each piece of the vocabulary at most.
    expected = {r.piece: r.expected for r in found.groupBy("piece").agg(F.sum("expected").alias("expected")).collect()}
    real = [i for i, w in enumerate(vocabulary.initial) if w > -math.inf]
    total = sum(sorted(expected.values())) + ends + SMOOTHING * (len(real) + 1)
    weights = [-math.inf] * vocabulary.size
    for i in real:
        weights[i] = math.log((expected.get(i, 0.0) + SMOOTHING) / total)
    return weights, math.log((ends + SMOOTHING) / total)


def word_scores(words: DataFrame, weights: list[float], path: str) -> DataFrame:
    """words with lp, the log10 marginal probability of each word."""
    shared = words.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = pieces(path), shared.value
        for batch in batches:
            lp = [forward(own.edges(MARK + w.decode(), given))[-1] / _LOG10 for w in batch.column("word").to_pylist()]
            yield pa.record_batch({"word": batch.column("word"), "c": batch.column("c"), "n": batch.column("n"), "lp": pa.array(lp, pa.float64())})

    return words.select("word", "c", "n").mapInArrow(score, "word binary, c long, n long, lp double")


def frequent_words(words: DataFrame, most: int) -> DataFrame:
    """The most frequent of words (word, n), `most` at most: all from the least count on that leaves no more.

    Counts are first put into classes by their logarithm, some thousand at most, so that no task orders the words.
    """
    kind = F.floor(F.log("n") * CLASSES)
    sizes = {r.kind: r.words for r in words.groupBy(kind.alias("kind")).agg(F.count("*").alias("words")).collect()}
    least, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    return words.filter(F.lit(False) if least is None else kind >= least)


def score_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; docs must be a scan.

    Texts whose crc32(id as text) is divisible by ten are held out of training (a null id is the empty text, held out).
    Tokens are the words and one end; the base score is that of a smoothed unigram model of whole words. A null or
    empty text has the end alone. Equal rows each give a row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = with_row_id(pick(docs, doc_id=id_column, text=text_column)).withColumn(
        "held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    )
    words = stored(count_words(base), "words")
    ends = base.filter("NOT held_out").count()
    trained = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("v")).first()
    tokens, distinct = trained.c + ends, trained.v + (ends > 0)
    spread = spread_words(words)
    weights, end_weight = fit_weights(spread, ends, path)
    scored_words = stored(word_scores(spread, weights, path), "word-scores")
    bottom = SMOOTHING * (distinct + 1) + tokens
    shift = math.log10(bottom) if bottom else 0.0
    listed = frequent_words(scored_words, frequent).select("word", "c", "lp").toArrow()
    c = listed["c"].to_numpy()
    places = {w: i for i, w in enumerate(listed["word"].to_pylist())}
    table = spark.sparkContext.broadcast((places, np.log10(c + SMOOTHING), c > 0, listed["lp"].to_numpy()))
    end = (math.log10(ends + SMOOTHING), int(ends > 0), end_weight / _LOG10)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bases, in_training, lps = table.value[0].get, *table.value[1:]
        for batch in batches:
            rows: dict[str, list] = {"n_tokens": [], "n_known": [], "base": [], "lp": [], "rest": []}
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                rest = Counter([words[i] for i in np.flatnonzero(found < 0).tolist()])
                found = found[found >= 0]
                rows["n_tokens"].append(len(words) + 1)
                rows["n_known"].append(end[1] + int(np.count_nonzero(in_training[found])))
                rows["base"].append(end[0] + float(bases[found].sum()) - shift * (len(words) + 1))
                rows["lp"].append(end[2] + float(lps[found].sum()))
                rows["rest"].append([{"word": w, "times": n} for w, n in rest.items()])
            yield pa.record_batch(
                {
                    "row": batch.column("row"),
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "n_tokens": pa.array(rows["n_tokens"], pa.int64()),
                    "n_known": pa.array(rows["n_known"], pa.int64()),
                    "base": pa.array(rows["base"], pa.float64()),
                    "lp": pa.array(rows["lp"], pa.float64()),
                    "rest": pa.array(rows["rest"], pa.list_(pa.struct({"word": pa.binary(), "times": pa.int64()}))),
                }
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    columns = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lp double, rest array<struct<word:binary,times:bigint>>"
    partial = base.select("row", "doc_id", "held_out", "text").mapInArrow(score, columns)
    # The figures of a text's frequent words travel with its first other word, so each text is read once.
    spread = partial.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", F.posexplode_outer("rest").alias("at", "r"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    lone = spread.select(
        "row",
        # A text without other words gets a key of its own, lest all such rows meet; a match adds nothing.
        F.coalesce(F.col("r.word"), F.col("row").cast("string").cast("binary")).alias("word"),
        F.col("r.times").alias("times"),
        F.when(first, F.struct("doc_id", "held_out", "n_tokens", "n_known", "base", "lp")).alias("own"),
    )
    joined = lone.join(scored_words.select("word", F.col("c").alias("wc"), F.col("lp").alias("wlp")), "word", "left")
    times = F.coalesce("times", F.lit(0))
    added = joined.groupBy("row").agg(
        F.max("own").alias("own"),
        F.sum(F.when(F.col("wc") > 0, times).otherwise(0)).alias("known"),
        F.sum(F.coalesce(times * F.log10(F.col("wc") + SMOOTHING), F.lit(0.0))).alias("base"),
        F.sum(F.coalesce(times * F.col("wlp"), F.lit(0.0))).alias("lp"),
    )
    return added.select(
        "own.doc_id",
        "own.held_out",
        "own.n_tokens",
        (F.col("own.n_known") + F.col("known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("own.base") + F.col("base")).alias("base_score"),
        (F.col("own.lp") + F.col("lp")).alias("score"),
    )
