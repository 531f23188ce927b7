import random
from collections import Counter

import pytest
from helpers import CLASHING, LONG, SAME, empty, table, ugly, words

from codeloom.llm import repeats as R


def brute(rows, least):
    """Merged stretches of passages that occur more than once; equal (doc_id, text) rows are one document."""
    docs = sorted({(i, tuple(words(t))) for i, t in rows if i is not None})
    seen = Counter(w[k : k + least] for _, w in docs for k in range(len(w) - least + 1))
    out = set()
    for i, w in docs:
        start = end = None
        for k in range(len(w) - least + 1):
            if seen[w[k : k + least]] > 1:
                if start is None:
                    start = k
                elif k > end:
                    out.add((i, start, end))
                    start = k
                end = k + least
        if start is not None:
            out.add((i, start, end))
    return out


def got(df, least, symbol):
    return {(r.doc_id, r.first_word, r.end_word) for r in R.repeated(df, least, symbol).collect()}


def passages(seed, n=60, vocabulary=2000):
    r = random.Random(seed)
    shared = [[f"s{r.randrange(500)}" for _ in range(r.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = [f"w{r.randrange(vocabulary)}" for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,least,symbol", [(1, 12, 3), (2, 12, 5), (3, 7, 3), (4, 50, 13), (5, 20, 10)])
def test_against_brute_force(spark, seed, least, symbol):
    rows = passages(seed)
    assert got(table(spark, rows, CLASHING), least, symbol) == brute(rows, least)


def test_few_words_and_long_runs(spark):
    rows = [(1, "a b " * 40), (2, "a " * 30), (3, "b a " * 9), (4, "c " * 11)]
    assert got(table(spark, rows), 10, 4) == brute(rows, 10)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, R.LEAST)
    assert got(docs, R.LEAST, R.SYMBOL) == want and want


def test_defined_results(spark):
    found = got(ugly(spark), 10, 3)
    n = len(SAME.split())
    assert {(5, 0, n), (6, 0, n)} <= found and {i for i, _, _ in found} == {4, 5, 6}
    assert (4, 0, len(LONG.split())) in found  # it repeats within itself
    assert R.repeated(empty(spark)).count() == 0


def test_a_document_repeated_as_a_row_is_one_document(spark):
    assert got(table(spark, [(1, SAME), (1, SAME)]), 10, 3) == set()
    assert got(table(spark, [(1, SAME), (1, SAME + " more")]), 10, 3) == brute([(1, SAME), (1, SAME + " more")], 10)


@pytest.mark.parametrize("hot", [0, 1, 3])
def test_hot_passages_are_spread_and_stay_whole(spark, monkeypatch, hot):
    """A passage that most documents share, with rows beyond the limit in every batch."""
    r = random.Random(8)
    shared = [f"s{k}" for k in range(30)]
    rows = [(i, " ".join([f"w{r.randrange(10**6)}" for _ in range(r.randint(0, 15))] + (shared if i % 3 else []) + [f"v{r.randrange(10**6)}" for _ in range(20)])) for i in range(60)]
    monkeypatch.setattr(R, "HOT", hot)
    want = brute(rows, 20)
    assert got(table(spark, rows), 20, 5) == want and len(want) == 40
