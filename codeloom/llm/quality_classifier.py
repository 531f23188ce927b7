"""Operator 7, quality classifier: regularised quadratic discriminant.

Twelve statistics of a document are transformed towards normality (logs of counts,
logits of shares), standardised and given to a Gaussian for each class.  The class
covariances are shrunk towards the pooled one and that towards its mean variance;
scores are differences of the two log densities, by Mahalanobis distances from
Cholesky factors that are computed once and sent with the task.

Defined results
- null or empty text: no statistics; kept, with score null;
- very long texts: statistics over the whole text;
- repeated rows, null doc_id: scored like any other row; ties at the threshold: kept;
- a class without labelled rows (or an empty table): nothing is rejected, scores null;
- other columns: ignored in score(), passed through in keep().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_only, table
from .kernels import _WORD, flat, slice_batches, span_hash, spans
from .training import labelled_rows

#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 2000
SHRINK_TO_POOLED = 0.2
SHRINK_TO_SPHERE = 0.05
#: Rejected when log p(low) - log p(high) exceeds this.  Far above 0: a clean document lost costs more than a bad one kept.
THRESHOLD = 4.0
NAMES = ("chars", "words", "word_length", "distinct_words", "symbols", "upper", "digits", "line_length", "repeated_neighbours", "punctuation", "bars", "symbol_pairs")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:?'\"()-"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_SYMBOL = ~(_WORD | _PUNCT | _SPACE)
_BAR = np.zeros(256, bool)
_BAR[[ord(c) for c in "|<>{}[]"]] = True


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The transformed statistics of each text, and whether it has any (a word)."""
    data, off = flat(texts)
    docs = len(off) - 1
    size = np.diff(off).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), off)).astype(float)

    word = _WORD[data]
    start, end = spans(word, off)
    first = np.searchsorted(start, off, "left")
    n = np.diff(first).astype(float)
    lowered = np.where(_UPPER[data], data + 32, data)
    h = span_hash(lowered, start, end)
    doc = np.repeat(np.arange(docs), np.diff(first))
    key = (h >> np.uint64(16)) | (doc.astype(np.uint64) << np.uint64(48))
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (key[1:] == key[:-1])
    neighbours = np.bincount(doc[same], minlength=docs).astype(float)
    key.sort()
    fresh = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[fresh] >> np.uint64(48)).astype(np.int64), minlength=docs).astype(float)
    symbol = _SYMBOL[data]
    pair = np.zeros(len(data), bool)
    pair[1:] = symbol[1:] & symbol[:-1]

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        p = (x + 0.5) / (of + 1.0)
        return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-6))

    letters = np.bincount(doc, weights=end - start, minlength=docs)
    x = np.column_stack([
        np.log1p(size), np.log1p(n), np.log1p(letters / np.maximum(n, 1)), np.log1p(distinct) - 0.8 * np.log1p(n),
        share(count(symbol), size), share(count(_UPPER[data]), letters), share(count(_DIGIT[data]), letters), np.log1p(size / (count(data == 10) + 1)),
        share(neighbours, n), share(count(_PUNCT[data]), size), share(count(_BAR[data]), size), share(count(pair), size),
    ])
    return x, n > 0


@dataclass
class Discriminant:
    """Two Gaussians, each as mean, inverse Cholesky factor and log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, pooled: float = SHRINK_TO_POOLED, sphere: float = SHRINK_TO_SPHERE) -> Discriminant | None:
        """None where a class has fewer than two rows."""
        if min((y == 0).sum(), (y == 1).sum()) < 2:
            return None
        centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = (x - centre) / scale
        each = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
        shared = sum((y == k).mean() * each[k] for k in (0, 1))
        eye = np.eye(x.shape[1])
        factors, logdets = [], []
        for c in each:
            c = (1 - pooled) * c + pooled * shared
            c = (1 - sphere) * c + sphere * max(np.trace(c) / len(c), 1e-3) * eye
            low = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(low))
            logdets.append(2 * np.log(np.diag(low)).sum())
        return Discriminant(centre, scale, np.array([z[y == k].mean(0) for k in (0, 1)]), np.array(factors), np.array(logdets))

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log p(x | low quality) - log p(x | high quality)."""
        z = (x - self.centre) / self.scale
        d = [-0.5 * (np.square((z - self.means[k]) @ self.factors[k].T).sum(1) + self.logdets[k]) for k in (0, 1)]
        return d[0] - d[1]


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Discriminant | None:
    """The discriminant of a labelled sample; its texts are measured where they lie and only their statistics come to the driver."""

    def run(batches):
        for b in slice_batches(batches):
            x, ok = statistics(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), lists], ["doc_id", "label", "x"]).filter(pa.array(ok))

    got = labelled_rows(documents, labels, "quality", per_class).mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return Discriminant.fit(x, got.column("label").to_numpy())


def _scores(model: Discriminant | None, texts: pa.Array) -> np.ndarray:
    x, ok = statistics(texts)
    return np.where(ok, model.log_ratio(x), np.nan) if model else np.full(len(x), np.nan)


def score(df: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, log_ratio and keep of every row of df(doc_id, text)."""

    def run(batches):
        for b in slice_batches(batches):
            s = _scores(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, mask=np.isnan(s)), pa.array(~(s > threshold))], ["doc_id", "log_ratio", "keep"])

    return docs_only(df).mapInArrow(run, "doc_id long, log_ratio double, keep boolean")


def keep(df: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, with all its columns, that the classifier doesn't reject."""

    def run(batches):
        for b in slice_batches(batches):
            yield b.filter(pa.array(~(_scores(model, b.column("text")) > threshold)))

    return df.mapInArrow(run, df.schema)


def op7_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with their log density ratios."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels"))).filter("keep")
