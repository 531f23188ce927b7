import math

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHING, LONG, ROWS, empty, table, ugly
from helpers import words as plain_words

from codeloom.llm import toxicity as T
from codeloom.llm.kernels import mix, words


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return T.train(docs.filter("doc_id % 3 <> 0"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_gradients_are_those_of_differences():
    r = np.random.default_rng(1)
    w = words(pa.array(["some words stand here again", "and others there some"]))
    x = T.Inputs(w)
    doc, start, end = T.windows(w, 6, 6)
    ids, y, weight = T._ids(x, start, end, 6), np.array([1.0, 0.0], np.float32), np.array([0.7, 1.0], np.float32)
    p = {k: v.astype(np.float64) for k, v in T.start_parameters().items()}
    loss, g = T.gradients(p, x, ids, y, weight)
    for name in p:
        where = np.argwhere(np.abs(g[name]) > 1e-6)
        for at in where[r.permutation(len(where))[:4]]:
            k, at = tuple(at), 1e-3
            up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            up[name][k] += at
            down[name][k] -= at
            slope = (T.gradients(up, x, ids, y, weight)[0] - T.gradients(down, x, ids, y, weight)[0]) / (2 * at)
            assert abs(slope - g[name][k]) < 2e-3 * max(1, abs(slope)), name


def plain_windows(text, p, window, stride):
    """Probability of every window of a text, word by word and unit by unit, from the parameters alone."""
    h, d = T.HIDDEN, T.WORD_DIM
    vectors = []
    for word in plain_words(text):
        raw = word.encode()
        value = int(words(pa.array([word])).hash[0])
        own = value & (T.WORD_BUCKETS - 1) if value in p["known"] else T.WORD_BUCKETS
        framed = [1, *raw, 1]
        chars = np.zeros(T.CHAR_DIM)
        for k in range(len(raw)):
            code = (framed[k] * 65599 * 65599 + framed[k + 1] * 65599 + framed[k + 2]) % 2**64
            chars += p["chars"][int(mix(np.array([code], np.uint64))[0]) & (T.CHAR_BUCKETS - 1)]
        vectors.append(np.r_[p["words"][own][:d], chars / len(raw)].astype(float))
    sigma = lambda x: 1 / (1 + math.exp(-x))

    def states(seq, k):
        state, out = [0.0] * h, []
        for v in seq:
            gate = [sum(v[i] * p[f"x{k}"][i, j] for i in range(len(v))) + p[f"c{k}"][j] for j in range(3 * h)]
            rec = [sum(p[f"u{k}"][j, i] * state[i] for i in range(h)) for j in range(3 * h)]
            r = [sigma(gate[j] + rec[j]) for j in range(h)]
            z = [sigma(gate[h + j] + rec[h + j]) for j in range(h)]
            new = [math.tanh(gate[2 * h + j] + r[j] * rec[2 * h + j]) for j in range(h)]
            state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(h)]
            out.append(state)
        return out

    found, start = [], 0
    while vectors:
        seq = vectors[start : start + window]
        both = [f + b for f, b in zip(states(seq, "f"), states(seq[::-1], "b")[::-1])]
        weight = [math.exp(sum(a * x for a, x in zip(p["attend"], s))) for s in both]
        pooled = [sum(w * s[j] for w, s in zip(weight, both)) / sum(weight) for j in range(2 * h)]
        found.append((start, sigma(sum(o * x for o, x in zip(p["out"], pooled)) + p["bias"][0])))
        if start + window >= len(vectors):
            return found
        start += stride
    return found


def test_scores_against_plain_loops(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(12).collect()
    texts = [t for _, t in ROWS if t != LONG] + [" ".join((r.text or "").split()[:150]) for r in docs]
    doc, at, prob = T.window_scores(model, pa.array(texts), T.WINDOW, T.STRIDE)
    for k, text in enumerate(texts):
        want = plain_windows(text or "", model, T.WINDOW, T.STRIDE)
        assert [s for s, _ in want] == at[doc == k].tolist()
        assert np.allclose([v for _, v in want], prob[doc == k], atol=1e-4)


@pytest.mark.parametrize("n", [1, 5, 31, 32, 33, 48, 49, 100, 513])
def test_windows_overlap_and_cover_the_text(n):
    w = words(pa.array([" ".join("ab" for _ in range(n))]))
    doc, start, end = T.windows(w, 32, 16)
    assert len(doc) == (1 if n <= 32 else 1 + -(-(n - 32) // 16))
    assert start[0] == 0 and end[-1] == n and set(range(n)) == {k for s, e in zip(start, end) for k in range(s, e)}


def test_scores_do_not_depend_on_the_batch(model):
    texts = [t for _, t in ROWS if t]
    doc, _, prob = T.window_scores(model, pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(prob[doc == k], T.window_scores(model, pa.array([t]))[2], atol=1e-5)


def test_held_out_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 3 = 0")
    found = {r.doc_id: r.toxic for r in T.score(docs, model).collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    hits = [found[i] for i in found if label.get(i) == 1]
    alarms = [found[i] for i in found if label.get(i) == 0]
    assert len(hits) > 100 and np.mean(hits) >= 0.7
    assert np.mean(alarms) < 0.05


def test_defined_results(spark, model):
    rows = T.score(ugly(spark), model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id in (1, 2, 7):
            assert r.windows == 0 and r.score is None and not r.toxic
    n = len(LONG.split())
    assert next(r for r in rows if r.doc_id == 4).windows == 1 + -(-(n - 32) // 16)
    assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    assert T.score(empty(spark), model).count() == 0


def test_without_a_class_there_is_no_model(spark):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert T.train(table(spark, ROWS, CLASHING), labels) is None
    rows = T.score(ugly(spark), None).collect()
    assert len(rows) == len(ROWS) and all(r.score is None and not r.toxic for r in rows)


def test_ties_at_the_threshold_are_toxic(spark, model):
    df = table(spark, [(1, "one plain sentence")])
    s = T.score(df, model).first().score
    assert T.score(df, model, threshold=np.float32(s)).first().toxic
