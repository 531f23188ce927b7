import numpy as np
import pyarrow as pa
from helpers import CLASHING, ROWS, empty, table, ugly

from codeloom.llm import quality_classifier as C


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_log_ratio_is_that_of_two_gaussians():
    r = np.random.default_rng(0)
    x = np.vstack([r.normal(0, 1, (80, 3)) @ [[1, 0.5, 0], [0, 1, 0], [0, 0, 2]], r.normal(1, 2, (120, 3))])
    y = np.r_[np.zeros(80, int), np.ones(120, int)]
    m = C.Discriminant.fit(x, y)
    z = (x - x.mean(0)) / x.std(0)
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    both = 0.4 * cov[0] + 0.6 * cov[1]
    logs = []
    for k in (0, 1):
        c = (1 - C.SHRINK_TO_POOLED) * cov[k] + C.SHRINK_TO_POOLED * both
        c = (1 - C.SHRINK_TO_SPHERE) * c + C.SHRINK_TO_SPHERE * np.trace(c) / 3 * np.eye(3)
        d = z - z[y == k].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert np.allclose(m.log_ratio(x), logs[0] - logs[1])


def test_statistics_do_not_depend_on_the_batch():
    texts = [t for _, t in ROWS if t]
    whole, _ = C.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        one, _ = C.statistics(pa.array([t]))
        assert np.allclose(whole[k], one[0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = C.train(docs.filter("doc_id % 2 = 0"), lab)
    rows = C.score(docs.filter("doc_id % 2 = 1"), m).join(lab, "doc_id").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1]
    assert np.mean([not r.keep for r in bad]) > 0.9
    assert np.mean([r.keep for r in good]) > 0.97


def test_training_is_bounded_and_repeats_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = C.train(docs, lab), C.train(docs.repartition(7), lab.union(lab))
    assert np.array_equal(a.factors, b.factors) and np.array_equal(a.means, b.means)


def test_defined_results(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = C.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    rows = C.score(ugly(spark), m).collect()
    assert len(rows) == len(ROWS)
    assert all(r.keep and r.log_ratio is None for r in rows if r.doc_id in (1, 2, 7))
    kept = C.keep(ugly(spark), m)
    assert kept.columns == ["doc_id", "text", *CLASHING] and kept.count() == sum(r.keep for r in rows)
    assert C.score(empty(spark), m).count() == 0


def test_without_a_class_nothing_is_rejected(spark):
    docs = ugly(spark)
    for lab in (labels(spark, []), labels(spark, [(5, 1, 0), (6, 1, 0)]), labels(spark, [(5, 1, 0), (5, 0, 0), (None, 0, 0), (6, None, 1)])):
        m = C.train(docs, lab)
        assert m is None
        assert C.keep(docs, m).count() == len(ROWS)
    assert C.train(empty(spark), labels(spark, [(1, 0, 0)])) is None


def test_ties_at_the_threshold_are_kept(spark):
    docs = table(spark, [(1, "one plain sentence of words")])
    r = C.score(docs, m := C.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))).first()
    assert C.score(docs, m, threshold=r.log_ratio).first().keep
