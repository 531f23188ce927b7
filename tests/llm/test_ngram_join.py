import random
from itertools import combinations

import numpy as np
import pytest
from helpers import CLASHING, SAME, empty, ngram_set, table, ugly

from codeloom.llm import ngram_join as J


def brute(rows, n=J.N, threshold=J.THRESHOLD):
    sets = {}
    for i, t in rows:
        if i is not None and (s := ngram_set(t, n)):
            sets.setdefault(i, []).append(s)
    out = {}
    for a, b in combinations(sorted(sets), 2):
        best = max(len(x & y) / len(x | y) for x in sets[a] for y in sets[b])
        if best >= threshold:
            out[a, b] = best
    return out


def near_copies(seed=5, groups=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows, i = [], 0
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 300))]
        for _ in range(r.randint(1, 5)):
            w = [r.choice(vocabulary) if r.random() < 0.06 else x for x in base]
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def classes(rows, n=J.N, threshold=J.THRESHOLD):
    """{(doc_id, class_id, links)} of the documents, distinct (doc_id, set), that join another, and the joining pairs of different sets."""
    docs = sorted({(i, frozenset(s)) for i, t in rows if i is not None and (s := ngram_set(t, n))}, key=lambda d: (d[0], sorted(d[1])))
    label, links, near = list(range(len(docs))), [0] * len(docs), set()
    for (k, (a, x)), (m, (b, y)) in combinations(enumerate(docs), 2):
        if len(x & y) / len(x | y) >= threshold:
            links[k] += 1
            links[m] += 1
            if x != y:
                near.add((k, m))
            old, new = label[m], label[k]
            label = [new if v == old else v for v in label]
    least = {}
    for v, (i, _) in zip(label, docs):
        least[v] = min(i, least.get(v, i))
    return sorted((i, least[v], c) for v, (i, _), c in zip(label, docs, links) if c)


def joined(df, **kw):
    return sorted((r.doc_id, r.class_id, r.links) for r in J.join(df, **kw).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_divide_skip_is_exact(seed):
    r = np.random.default_rng(seed)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(60)]
    sets.sort(key=len)
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    got = {}
    for q, p, c in J.divide_skip(np.concatenate(sets).astype(np.uint64), first, 0.4):
        got |= {(int(a), int(b)): int(n) for a, b, n in zip(q, p, c)}
    want = {}
    for q in range(len(sets)):
        for p in range(q):
            n = len(np.intersect1d(sets[q], sets[p]))
            if n / (len(sets[q]) + len(sets[p]) - n) >= 0.4:
                want[q, p] = n
    assert got == want


def test_join_against_brute_force(spark):
    rows = near_copies()
    got, want = joined(table(spark, rows)), classes(rows)
    assert got == want and len(want) > 50 and any(c > 1 for _, _, c in want)


def test_pairs_against_brute_force(spark):
    rows = near_copies(seed=6)
    want = brute(rows)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.pairs(table(spark, rows)).collect()}
    assert set(got) == set(want) and all(abs(want[k] - v) < 1e-9 for k, v in got.items())


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_other_thresholds(spark, threshold):
    rows = near_copies(seed=11, groups=15)
    assert joined(table(spark, rows), threshold=threshold) == classes(rows, threshold=threshold)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert joined(docs) == classes([(r.doc_id, r.text) for r in docs.collect()])


def test_split_groups_lists_and_components_give_the_same(spark, monkeypatch):
    """With chunks of a few sets, and n-grams spread at once, every path that keeps tasks bounded is taken."""
    r = random.Random(4)
    base = [f"w{r.randrange(3000)}" for _ in range(90)]
    rows = near_copies(seed=3, groups=12) + [(500 + k, " ".join(r.choice(base) if r.random() < 0.08 else x for x in base)) for k in range(40)] + [(700 + k, SAME) for k in range(20)]
    want = classes(rows)
    monkeypatch.setattr(J, "CHUNK", 4)
    monkeypatch.setattr(J, "CHUNK_GRAMS", 500)
    monkeypatch.setattr(J, "SPREAD_TEXTS", 2)
    monkeypatch.setattr(J, "KNOWN_LISTS", 3)
    assert joined(table(spark, rows)) == want


def test_a_pair_at_the_threshold_meets_on_enough_lists():
    r = np.random.default_rng(0)
    for a, b in [(40, 60), (100, 128), (100, 200), (129, 130), (500, 500), (500, 900), (1000, 2000)]:
        o = int(np.ceil((a + b) / 3))
        for _ in range(300):
            h = r.permutation(a + b - o)
            x, y = h[:a], h[a - o :]
            x, y = np.sort(x)[: J.SKETCH], np.sort(y)[: J.SKETCH]
            need = J.occurrences(np.array([a]), np.array([b]))[0]
            assert len(np.intersect1d(x, y)) >= need >= max(J.least_occurrences([a])[0], J.least_occurrences([b])[0]) - 1


def test_keep_one_keeps_the_least_of_each_group(spark):
    rows = near_copies(seed=9)
    near = brute(rows)
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = {i for i in label if label[i] == i}
    got = [r.doc_id for r in J.keep_one(table(spark, rows, CLASHING)).collect()]
    assert sorted(got) == sorted(want)


def test_large_groups_and_shared_passages(spark):
    r = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, SAME) for k in range(300)]
    rows += [(1000 + k, passage + " " + " ".join(f"v{r.randrange(10**6)}" for _ in range(200))) for k in range(200)]
    assert joined(table(spark, rows)) == [(k, 0, 299) for k in range(300)]  # a passage that many share joins nobody


def test_defined_results(spark):
    assert joined(ugly(spark)) == [(5, 5, 1), (6, 5, 1)]
    kept = J.keep_one(ugly(spark))
    assert kept.columns == ugly(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8] and ids.count(None) == 2
    assert J.join(empty(spark)).count() == 0 and J.keep_one(empty(spark)).count() == 0


def test_short_texts_join_only_texts_of_the_same_words(spark):
    rows = [(1, "two words"), (2, "two words"), (3, "Two, words!"), (4, "two"), (5, "other words")]
    assert joined(table(spark, rows)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    assert joined(table(spark, [(1, "two words here now"), (1, "other words there then"), (2, "two words here now"), (3, "Other words there, then")])) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
