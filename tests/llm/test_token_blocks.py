import numpy as np
import pytest
from helpers import LONG, ROWS, empty, table, ugly

from codeloom.llm import token_blocks as B


def run(df):
    blocks = B.id_blocks(df).cache()
    t = B.Table.build(B.frequencies(blocks))
    return t, B.encoded(blocks, t).collect()


def test_documents_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t, rows = run(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    enc = B._encoder(B.VOCABULARY)
    seen = []
    for r in rows:
        ids = B.decode_row(r, t)
        at = 0
        for i, n in zip(r.doc_ids, r.doc_tokens):
            assert enc.decode(ids[at : at + n].tolist()) == text[i]
            at += n
            seen.append(i)
        parts = [B.decode_row(r, t, c) for c in range(len(r.checkpoint_words))]
        assert np.array_equal(np.concatenate(parts), ids)  # checkpoints decode alone
    assert sorted(seen) == sorted(text)
    raw = sum(2 * r.tokens for r in rows)
    assert sum(len(r.payload) for r in rows) < 0.9 * raw


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
@pytest.mark.parametrize("checkpoint", [1, 3, 256])
def test_any_length_round_trips(n, checkpoint):
    ids = np.random.default_rng(n).zipf(1.3, n) % 300
    t = B.Table.build(np.bincount(ids, minlength=300), bits=12)
    payload, states, places, steps = B.encode(ids, t, lanes=16, checkpoint=checkpoint)
    assert np.array_equal(B.decode(payload, states, places, n, t, lanes=16, checkpoint=checkpoint), ids)
    for c in range(len(states)):
        part = B.decode(payload, states, places, n, t, c, lanes=16, checkpoint=checkpoint)
        assert np.array_equal(part, ids[c * checkpoint * 16 : (c + 1) * checkpoint * 16])


def test_table_fills_its_slots():
    for counts in ([1], [5, 0, 1], [10**9, 1, 1, 0], list(range(1000))):
        t = B.Table.build(np.array(counts), bits=10)
        assert t.freq.sum() == 1024 and ((t.freq > 0) == (np.array(counts) > 0)).all()
    with pytest.raises(ValueError):
        B.Table.build(np.ones(2000, np.int64), bits=10)


def test_damage_is_found(spark):
    t, rows = run(table(spark, [(1, "some words to code")]))
    r = rows[0].asDict()
    B.decode_row(r, t)
    with pytest.raises(ValueError):
        B.decode_row(r | {"payload_crc": r["payload_crc"] ^ 1}, t)
    with pytest.raises(ValueError):
        B.decode_row(r | {"token_crc": r["token_crc"] ^ 1}, t)


def test_defined_results(spark):
    t, rows = run(ugly(spark))
    ids = [i for r in rows for i in r.doc_ids]
    assert sorted(map(str, ids)) == sorted(str(i) for i, _ in ROWS)
    sizes = {i: n for r in rows for i, n in zip(r.doc_ids, r.doc_tokens)}
    assert sizes[1] == sizes[2] == 0 and sizes[4] == len(B._encoder(B.VOCABULARY).encode_ordinary(LONG))
    t, rows = run(empty(spark))
    assert rows == []
    with pytest.raises(ValueError):
        B.encode(np.array([5]), B.Table.build(np.array([1, 1])))


def test_the_query_s_rows_alone_decode(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    B.op10_rans_blocks(spark, sf).write.parquet(f"{tmp_path}/out")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc, seen = B._encoder(B.VOCABULARY), []
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    for r, ids in B.blocks(rows):
        at = 0
        for i, n in zip(r.doc_ids, r.doc_tokens):
            assert enc.decode(ids[at : at + n].tolist()) == text[i]
            at += n
            seen.append(i)
    assert sorted(seen) == sorted(text) and sum(r.table is not None for r in rows) == 1
    with pytest.raises(ValueError):
        list(B.blocks([r for r in rows if r.table is None]))


def test_an_empty_table_has_no_row(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert B.op10_rans_blocks(spark, str(tmp_path)).count() == 0
