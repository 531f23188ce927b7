import shutil

import pyarrow as pa
import pytest
from helpers import ROWS, SAME
from test_ngram_join import brute

import corpus_pipeline as P
from codeloom.llm import decontamination, packing, quality_classifier, secret_scan
from codeloom.llm.common import table
from codeloom.llm.token_blocks import _encoder

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, as rows."""
    docs, out = table(spark, SF, "documents"), []
    for _, f in P.STAGES:
        new = f(spark, docs, SF).cache()
        out.append((docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_stages_call_the_operators_in_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_all_but_the_last_return_documents(stages):
    assert all(c == COLUMNS for _, _, c in stages[:-1])


def test_quality(spark, stages):
    before, after, _ = stages[0]
    m = quality_classifier.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    want = {r.doc_id for r in before if not quality_classifier._scores(m, pa.array([r.text]))[0] > quality_classifier.THRESHOLD}
    assert {r.doc_id for r in after} == want and 0 < len(want) < len(before)


def test_near_duplicates(stages):
    before, after, _ = stages[1]
    label = {r.doc_id: r.doc_id for r in before}
    near = brute([(r.doc_id, r.text) for r in before])
    for _ in label:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = {i for i in label if label[i] == i}
    got = [r.doc_id for r in after]
    assert sorted(got) == sorted(want)
    text = {r.doc_id: r for r in before}
    assert all(text[r.doc_id] == r for r in after)


def test_benchmark(spark, stages):
    before, after, _ = stages[2]
    index = next(decontamination.indexes(table(spark, SF, "benchmark")))
    want = {r.doc_id for r in before if not decontamination._match(index, pa.array([r.text]))}
    assert {r.doc_id for r in after} == want and len(want) < len(before)


def test_secrets(stages):
    before, after, _ = stages[3]
    text = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        found, new, at = secret_scan.findings(text[r.doc_id]), "", 0
        for s, e, k, _, _ in found:
            new, at = new + text[r.doc_id][at:s] + f"[{secret_scan.RULES[k][1]}]", e
        assert r.text == new + text[r.doc_id][at:] and (not found or r.n_chars == len(r.text))


def test_bins(stages):
    before, after, _ = stages[4]
    enc = _encoder(packing.VOCABULARY)
    size = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in before}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.tokens
    assert got == {i: n for i, n in size.items() if n}
    filled = {}
    for r in after:
        filled[r.bin_id] = filled.get(r.bin_id, 0) + r.tokens
    assert max(filled.values()) <= packing.CAPACITY


def test_run_gives_what_the_stages_give(spark, stages):
    assert sorted(P.run(spark, SF).collect()) == sorted(stages[-1][1])


@pytest.mark.parametrize("rows", [ROWS, []])
def test_ugly_and_empty_tables(spark, tmp_path, rows):
    d = str(tmp_path)
    data = [(i, t, None, "s", None, "x", "y") for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, component string, `label` string").write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{name}.parquet", f"{d}/{name}.parquet")
    out = P.run(spark, d).collect()
    ids = {r.doc_id for r in out}
    if not rows:
        assert out == []
    else:
        kept = {i for i, t in rows if t and i not in (6,)}
        assert ids <= kept and 5 in ids and None in ids
        assert sum(r.tokens for r in out if r.doc_id == 5) == len(_encoder(packing.VOCABULARY).encode_ordinary(SAME))
