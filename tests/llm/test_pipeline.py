"""The pipeline against brute force, stage by stage."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from riskspark.llm import byte_bpe, line_dedup, quality  # noqa: E402
from test_line_dedup import brute as brute_lines  # noqa: E402
from test_map_operators import brute_windows  # noqa: E402
from test_near_dedup import brute_classes  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def words_in_repeats(words, k):
    """Words inside windows of k words that are found twice or more."""
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    seen = Counter(windows)
    return len({j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + k)})


def plainly_good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if n < 50 or 100 * words_in_repeats(words, 3) > 50 * n:
        return False
    return words_in_repeats(words, quality.MIN_REPEAT) <= quality.MAX_COVERED * n and not words_in_repeats(words, quality.MAX_LONGEST + 1)


def expected():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()
    rows = [r for r in rows if plainly_good(r[1])]
    yield rows
    rows = [(i, t) for i, _, _, t in brute_lines(rows, line_dedup.MAX_EDITS, line_dedup.MIN_CHARS, every_line=True) if t.split()]
    yield rows
    seen = set()
    rows = [r for r, c in zip(rows, brute_classes([t for _, t in rows])) if not (c in seen or seen.add(c))]
    yield rows
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()
    rows = [r for r, found in zip(rows, brute_windows([t for _, t in rows], items)) if not found[3]]
    yield rows
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [np.array(library.encode_ordinary(t), "<u4").tobytes() for _, t in rows]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    yield [(i, len(x) // 4, x, digest(x), digest(t.encode())) for (i, t), x in zip(rows, ids)]


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for k, ((_, stage), want) in enumerate(zip(corpus_pipeline.STAGES, expected(), strict=True)):
        stage(spark, docs, SF_DIR).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
        else:
            assert sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == want
    assert len(want) > 50
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(want)
