import random
from collections import Counter, defaultdict

import pytest
from helpers import LONG, ROWS, empty, table, ugly

from codeloom.llm import packing as P
from codeloom.llm.token_blocks import _encoder


def naive(sizes, capacity):
    """The same rules by plain search; sizes from the largest down."""
    place = [None] * len(sizes)
    bins = []  # used
    for k, n in enumerate(sizes):
        if place[k] is None and 3 * n > capacity:
            place[k] = (len(bins), 0)
            used = n
            for j in range(k + 1, len(sizes)):
                if place[j] is None and 3 * sizes[j] > capacity and used + sizes[j] <= capacity:
                    place[j] = (len(bins), used)
                    used += sizes[j]
                    break
            bins.append(used)
    for k, n in enumerate(sizes):
        if place[k] is None:
            fit = [(capacity - u, b) for b, u in enumerate(bins) if 0 < capacity - u and capacity - u >= n]
            if fit:
                _, b = min(fit)
            else:
                b = len(bins)
                bins.append(0)
            place[k] = (b, bins[b])
            bins[b] += n
    return place


@pytest.mark.parametrize("seed", range(30))
def test_pack_is_the_plain_search(seed):
    r = random.Random(seed)
    cap = r.choice([10, 30, 100])
    sizes = sorted((r.randint(1, cap) for _ in range(r.randint(0, 80))), reverse=True)
    assert P.pack(sizes, cap) == naive(sizes, cap)


def check(rows, capacity, texts):
    by = defaultdict(list)
    for r in rows:
        by[r.bin_id].append(r)
        assert 0 < r.tokens <= capacity and r.first_token == r.piece * capacity
    for own in by.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at
            at += r.tokens
        assert at <= capacity and sum(3 * r.tokens > capacity for r in own) <= 2
    enc = _encoder(P.VOCABULARY)
    total = sum(len(enc.encode_ordinary(t or "")) for t in texts)
    assert sum(r.tokens for r in rows) == total
    return len(by), total


def test_documents_fill_their_bins(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.packed(docs).collect()
    bins, total = check(rows, P.CAPACITY, [r.text for r in docs.select("text").collect()])
    assert bins <= 1.02 * total / P.CAPACITY + 1


def test_shards_and_order_change_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    check(P.packed(docs, shard=50).collect(), P.CAPACITY, texts)
    a, b = ({(r.bin_id, r.doc_id, r.piece, r.bin_offset) for r in P.packed(d).collect()} for d in (docs, docs.repartition(5)))
    assert a == b


def test_defined_results(spark):
    rows = P.packed(ugly(spark)).collect()
    check(rows, P.CAPACITY, [t for _, t in ROWS])
    assert {r.doc_id for r in rows} == {3, 4, 5, 6, None, 7, 8}
    assert len([r for r in rows if r.doc_id == 5]) == 2
    whole = sorted(r.piece for r in rows if r.doc_id == 4)
    assert whole == list(range(-(-len(_encoder(P.VOCABULARY).encode_ordinary(LONG)) // P.CAPACITY)))
    assert P.packed(empty(spark)).count() == 0
    assert P.packed(table(spark, [(1, None), (2, "")])).count() == 0


def test_the_query_counts_tokens(spark):
    sf = "/root/testdata/sf0.001"
    rows = P.op8_best_fit_bins(spark, sf).collect()
    enc, want = _encoder(P.VOCABULARY), Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want[r.doc_id] += len(enc.encode_ordinary(r.text or ""))
    got, filled = Counter(), Counter()
    for r in rows:
        got[r.doc_id] += r.tokens
        filled[r.bin_id] += r.tokens
        assert r.first_token == r.piece * P.CAPACITY
    assert got == +want and max(filled.values()) <= P.CAPACITY
