"""Token queries against the public libraries on a whole table."""

import base64
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from riskspark.llm import queries

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def words():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    return library


def digest(data):
    return hashlib.sha256(data).hexdigest()


def rows(df, *columns):
    return sorted(map(tuple, df.select("doc_id", *columns).collect()))


def test_token_counts(spark, documents, words):
    got = rows(queries.op4_token_counts(spark, SF_DIR), "n_bytes", "n_tokens", "over_limit")
    sizes = [len(e.ids) for e in words.encode_batch([t for _, t in documents], add_special_tokens=False)]
    assert got == [(i, len(t.encode()), n, n > 2048) for (i, t), n in zip(documents, sizes)]


def test_byte_bpe(spark, documents):
    got = rows(queries.op9_byte_bpe(spark, SF_DIR), "n_tokens", "ids_sha256", "decoded_sha256")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [library.encode_ordinary(t) for _, t in documents]
    assert got == [(i, len(x), digest(np.array(x, "<u4").tobytes()), digest(t.encode())) for (i, t), x in zip(documents, ids)]


def test_word_bpe(spark, documents, words):
    got = rows(queries.op11_word_bpe(spark, SF_DIR), "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in documents:
        ids = words.encode(t, add_special_tokens=False).ids
        plain = words.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest(plain.encode())))
    assert got == want
