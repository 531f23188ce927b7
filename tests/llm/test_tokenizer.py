import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, ROWS, empty, ugly

from codeloom.llm import tokenizer as K
from codeloom.llm.token_blocks import _encoder


def brute(texts, path=K.VOCABULARY):
    return [len(_encoder(path).encode_ordinary(t or "")) for t in texts]


def strings(seed, n=400):
    r = random.Random(seed)
    alphabets = ["ab ", "it's don't we'll I've they're 'twas ", "  \t\n\r x", "0123 45,.!?'", "éß世界🎉 ñ  ", "<|endoftext|> a", "aAbBcC 'S'T'RE", "\x00\x85  k'll'v're"]
    return ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [K.VOCABULARY, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"])
def test_counts_are_those_of_the_tokenizer(path):
    texts = strings(1) + [LONG, None, "", "'", "''", " '", "a'", "'l", "'ll", " 're", "x" * 3000, "  " * 500]
    got, _ = K.count_tokens(pa.array(texts, pa.string()), path)
    assert got.tolist() == brute(texts, path)


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_pieces_do_not_depend_on_chunks(chunk):
    texts = pa.array(strings(2, 100))
    a, b = K.pieces(texts, chunk), K.pieces(texts)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_scan_composes_in_order():
    r = np.random.default_rng(0)
    maps = r.integers(0, 10, (37, 10)).astype(np.uint8)
    scan, now = K.compose(maps), np.arange(10)
    for k in range(37):
        now = maps[k][now]
        assert np.array_equal(scan[k], now)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.tokens for r in K.token_counts(docs).collect()}
    rows = docs.collect()
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])


def test_counter_begins_anew_when_it_is_full(monkeypatch):
    monkeypatch.setattr(K, "STATES", 50)
    texts = strings(3, 60)
    for _ in range(3):
        assert K.count_tokens(pa.array(texts))[0].tolist() == brute(texts)


def test_defined_results(spark):
    rows = K.token_counts(ugly(spark)).collect()
    assert sorted(r.tokens for r in rows) == sorted(brute([t for _, t in ROWS]))
    assert all((r.tokens, r.pieces) == (0, 0) for r in rows if r.doc_id in (1, 2))
    assert K.token_counts(empty(spark)).count() == 0
