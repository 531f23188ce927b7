"""Operator 3, toxicity: a bidirectional gated recurrent network with attention pooling.

Each word enters as a hashed word vector and the mean of its hashed character
trigram vectors.  Two gated recurrent layers read a window in both directions,
attention pools their states and a logistic unit scores the window.  Training is
plain numpy with hand-written back-propagation.  A document's score is that of its
worst window; of all documents the windows that begin every STRIDE words are scored
(the README gives what that costs against every word).

The input part of the gates depends on the word alone, so it is computed once for
each distinct word of a batch and looked up at every position.

Defined results
- null, empty and wordless texts: no windows, score null, not toxic;
- texts shorter than a window: one window; very long texts: all their windows;
- repeated rows and null doc_id: scored like any other row;
- no labelled documents of either class (or empty tables): every score null;
- the threshold is 0.5, or higher where held-out clean documents ask for it; ties at it: toxic; other columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import docs_only, table
from .kernels import Words, mix, slice_batches, slices, words
from .training import labelled

#: Labelled documents of each class that the network is fitted on, at most.
PER_CLASS = 1500
#: A word has a vector of its own if this many of the fitted documents hold it; rarer words have their characters only, so that names of single documents can't be learned by heart.
LEAST_DOCS = 6
#: Weight of windows of toxic documents, most of which are harmless.
TOXIC_WEIGHT = 0.3
#: Share of the labelled sample held out to place the threshold, which is best by recall less so many times the share of clean documents flagged.
HELD_OUT, CLEAN_COST = 0.25, 4.0
WINDOW, STRIDE = 32, 16
THRESHOLD = 0.5
HIDDEN, WORD_DIM, CHAR_DIM = 8, 12, 12
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 12
EPOCHS, RATE, BATCH, SEED = 5, 0.01, 256, 7
#: From this epoch on, a toxic document teaches by the windows that score at least half its worst one.
FOCUS_FROM = 2
#: Share of word vectors hidden in each step, so that characters are learned too; and the decay of the vectors.
WORD_DROP, DECAY = 0.5, 0.5
_BLOCK = 4096


class Inputs:
    """Distinct words of a batch: ids of the words, their buckets and character trigrams."""

    def __init__(self, w: Words, known: np.ndarray | None = None):
        value, at, self.ids = np.unique(w.hash, return_index=True, return_inverse=True)
        self.n = len(at)
        self.bucket = (value & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        if known is not None:
            self.bucket[~np.isin(value, known)] = WORD_BUCKETS
        s, e = w.start[at], w.end[at]
        size = e - s + 2
        self.first = np.r_[0, np.cumsum(size)]
        framed = np.full(self.first[-1] + 2, 1, np.uint64)
        inside = np.ones(self.first[-1], bool)
        inside[self.first[:-1]] = False
        inside[self.first[1:] - 1] = False
        framed[1 : self.first[-1] + 1][inside] = w.data[slices(s, e)]
        tri = framed[:-2] * np.uint64(65599 * 65599) + framed[1:-1] * np.uint64(65599) + framed[2:]
        keep = inside  # one trigram for each character of the word
        self.tri = (mix(tri[keep]) & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64)
        self.len = np.maximum(e - s, 1)
        self.owner = np.repeat(np.arange(self.n), e - s)
        self.at = np.r_[0, np.cumsum(e - s)][:-1]

    def vectors(self, p: dict) -> np.ndarray:
        """(distinct words, WORD_DIM + CHAR_DIM)"""
        if not self.n:
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(p["chars"][self.tri], self.at, axis=0) / self.len[:, None].astype(np.float32)
        return np.hstack([p["words"][self.bucket], chars])


def windows(w: Words, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and past-the-end word of each window, in reading order."""
    n = np.diff(w.first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // stride)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = w.first[doc] + k * stride
    return doc, start, np.minimum(start + window, w.first[doc + 1])


def start_parameters(seed: int = SEED) -> dict:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"words": r.normal(0, 0.1, (WORD_BUCKETS + 1, WORD_DIM)), "chars": r.normal(0, 0.3, (CHAR_BUCKETS, CHAR_DIM))}
    for k in "fb":
        p |= {f"x{k}": r.normal(0, d**-0.5, (d, 3 * h)), f"u{k}": r.normal(0, h**-0.5, (3 * h, h)), f"c{k}": np.zeros(3 * h)}
    p |= {"attend": r.normal(0, 0.1, 2 * h), "out": r.normal(0, (2 * h) ** -0.5, 2 * h), "bias": np.array([-2.0])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _direction(gates: np.ndarray, ids: np.ndarray, u: np.ndarray, order, keep: list | None) -> np.ndarray:
    """States (steps, HIDDEN, windows) of one direction.  ids: (steps, windows), into rows of gates."""
    steps, n = ids.shape
    h = HIDDEN
    state = np.zeros((h, n), np.float32)
    out = np.empty((steps, h, n), np.float32)
    for t in order:
        g = gates[ids[t]].T.copy()
        rec = u @ state
        rz = np.tanh(0.5 * (g[: 2 * h] + rec[: 2 * h]))
        rz *= 0.5
        rz += 0.5
        new = np.tanh(g[2 * h :] + rz[:h] * rec[2 * h :])
        if keep is not None:
            keep.append((t, state, rz, new, rec[2 * h :]))
        state = new + rz[h:] * (state - new)
        out[t] = state
    return out


def _tables(p: dict, x: np.ndarray) -> dict:
    """Gate inputs of each distinct word; a last row for padding, which leaves the state as it is."""
    tables = {}
    for k in "fb":
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[0, HIDDEN : 2 * HIDDEN] = 40.0
        tables[k] = np.vstack([x @ p[f"x{k}"] + p[f"c{k}"], pad]).astype(np.float32)
    return tables


def _forward(p: dict, tables: dict, ids: np.ndarray, pad: int, saved: dict | None = None) -> np.ndarray:
    """Logits of windows; ids: (steps, windows)."""
    steps = ids.shape[0]
    keep = {k: ([] if saved is not None else None) for k in "fb"}
    f = _direction(tables["f"], ids, p["uf"], range(steps), keep["f"])
    b = _direction(tables["b"], ids, p["ub"], range(steps - 1, -1, -1), keep["b"])
    a = np.einsum("h,thn->tn", p["attend"][:HIDDEN], f) + np.einsum("h,thn->tn", p["attend"][HIDDEN:], b)
    a[ids == pad] = -1e9
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = np.vstack([np.einsum("tn,thn->hn", a, f), np.einsum("tn,thn->hn", a, b)])
    if saved is not None:
        saved |= {"f": f, "b": b, "a": a, "pooled": pooled, "keep": keep}
    return p["out"] @ pooled + p["bias"][0]


def _backward(p: dict, saved: dict, ids: np.ndarray, rows: int, dlogit: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the shared parameters, and of the gate tables."""
    h, g = HIDDEN, {}
    a, pooled = saved["a"], saved["pooled"]
    g["out"], g["bias"] = pooled @ dlogit, np.array([dlogit.sum()], np.float32)
    dpool = np.outer(p["out"], dlogit)
    states = {"f": saved["f"], "b": saved["b"]}
    dp = {"f": dpool[:h], "b": dpool[h:]}
    da = sum(np.einsum("hn,thn->tn", dp[k], states[k]) for k in "fb")
    da = a * (da - (a * da).sum(0))
    g["attend"] = np.concatenate([np.einsum("tn,thn->h", da, states[k]) for k in "fb"])
    dtables = {}
    for k, part in (("f", p["attend"][:h]), ("b", p["attend"][h:])):
        u, carry = p[f"u{k}"], np.zeros_like(dp[k])
        du = np.zeros_like(u)
        each = np.zeros((ids.shape[0], 3 * h, ids.shape[1]), np.float32)
        for t, prev, rz, new, rec in reversed(saved["keep"][k]):
            d = carry + a[t] * dp[k] + part[:, None] * da[t]
            r, z = rz[:h], rz[h:]
            dn = d * (1 - z) * (1 - new * new)
            dz = d * (prev - new) * z * (1 - z)
            dr = dn * rec * r * (1 - r)
            each[t] = np.vstack([dr, dz, dn])
            drec = np.vstack([dr, dz, dn * r])
            du += drec @ prev.T
            carry = d * z + u.T @ drec
        g[f"u{k}"] = du
        flat = each.transpose(0, 2, 1).reshape(-1, 3 * h)
        order = np.argsort(ids.ravel(), kind="stable")
        sid = ids.ravel()[order]
        edge = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
        table = np.zeros((rows, 3 * h), np.float32)
        table[sid[edge]] = np.add.reduceat(flat[order], edge, axis=0)
        dtables[k] = table
    return g, dtables


def gradients(p: dict, x: Inputs, ids: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, dict]:
    """Mean weighted cross-entropy over windows, and its gradient for every parameter."""
    v = x.vectors(p)
    saved: dict = {}
    logit = _forward(p, _tables(p, v), ids, x.n, saved)
    prob = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
    g, dt = _backward(p, saved, ids, x.n + 1, (weight * (prob - y) / len(y)).astype(np.float32))
    dv = np.zeros_like(v)
    for k in "fb":
        t = dt[k][:-1]
        g[f"x{k}"], g[f"c{k}"] = v.T @ t, t.sum(0)
        dv += t @ p[f"x{k}"].T
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], x.bucket, dv[:, :WORD_DIM])
    g["chars"] = np.zeros_like(p["chars"])
    np.add.at(g["chars"], x.tri, (dv[:, WORD_DIM:] / x.len[:, None])[x.owner])
    return loss, g


def _ids(x: Inputs, start: np.ndarray, end: np.ndarray, steps: int) -> np.ndarray:
    at = start[None, :] + np.arange(steps)[:, None]
    inside = at < end[None, :]
    padded = np.r_[x.ids, x.n]
    return np.where(inside, padded[np.minimum(at, len(x.ids))], x.n)


def fit(rows: list[tuple[int, str, int]], epochs: int = EPOCHS, seed: int = SEED, window: int = WINDOW) -> dict | None:
    """A network fitted on (doc_id, text, toxic) rows; windows inherit their document's label.

    Beside the parameters it has ``known``, the hashes of words with vectors of their
    own, and ``threshold``.  None where a class has no row.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = [rows[i] for i in order[: int(len(rows) * HELD_OUT)]]
    rows = [rows[i] for i in order[len(held) :]]
    if len({r[2] for r in rows}) < 2:
        return None
    w = words(pa.array([r[1] for r in rows], pa.string()))
    pairs = np.unique(np.column_stack([w.hash, w.doc.astype(np.uint64)]), axis=0)
    value, docs = np.unique(pairs[:, 0], return_counts=True)
    known = value[docs >= LEAST_DOCS]
    x = Inputs(w, known)
    doc, start, end = windows(w, window, window)
    if not len(doc):
        return None
    y = np.array([r[2] for r in rows], np.float32)[doc]
    weight = np.where(y > 0, np.float32(TOXIC_WEIGHT), np.float32(1))
    ids = _ids(x, start, end, window)
    p = start_parameters(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(doc))
        if epoch >= FOCUS_FROM:
            prob = _probabilities(p, x, ids)
            worst = np.zeros(len(rows), np.float32)
            np.maximum.at(worst, doc, prob)
            weight = np.where(y > 0, np.where(prob >= 0.5 * worst[doc], np.float32(TOXIC_WEIGHT), np.float32(0)), np.float32(1))
        for s in range(0, len(order), BATCH):
            pick = order[s : s + BATCH]
            own, local = np.unique(ids[:, pick], return_inverse=True)
            sub = _subset(x, own)
            sub.bucket = np.where(rng.random(sub.n) < WORD_DROP, WORD_BUCKETS, sub.bucket)
            _, g = gradients(p, sub, local.reshape(window, -1), y[pick], weight[pick])
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                if DECAY and k in ("words", "chars"):
                    p[k] *= np.float32(1 - rate * DECAY)
    p["known"] = known
    of, _, prob = window_scores(p, pa.array([r[1] for r in held], pa.string()))
    worst = np.zeros(len(held), np.float32)
    np.maximum.at(worst, of, prob)
    p["threshold"] = _threshold(worst, np.array([r[2] for r in held], int))
    return p


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The best cut of held-out scores, in the middle of its gap; THRESHOLD at least, and where a class is missing."""
    if len(set(label.tolist())) < 2:
        return THRESHOLD
    cuts = np.unique(np.r_[THRESHOLD, score[score > THRESHOLD]])
    toxic, clean = np.sort(score[label == 1]), np.sort(score[label == 0])
    above = lambda x, side: 1 - np.searchsorted(x, cuts, side) / len(x)
    gain = above(toxic, "left") - CLEAN_COST * above(clean, "left")
    best = int(gain.argmax())
    lower = max([THRESHOLD, *clean[clean < cuts[best]].tolist()])
    return float((cuts[best] + lower) / 2)


def _subset(x: Inputs, own: np.ndarray) -> Inputs:
    """The inputs of distinct words ``own``; x.n, the padding, keeps the last place."""
    real = own[own < x.n]
    s = Inputs.__new__(Inputs)
    s.n = len(real)
    if len(own) == len(real):  # no padding among them: the place after the last stays free for it
        s.ids = None
    s.bucket, s.len = x.bucket[real], x.len[real]
    lens = np.diff(np.r_[x.at, len(x.tri)])[real]
    s.tri = x.tri[slices(x.at[real], x.at[real] + lens)]
    s.at = np.r_[0, np.cumsum(lens)][:-1]
    s.owner = np.repeat(np.arange(s.n), lens)
    return s


def _probabilities(p: dict, x: Inputs, ids: np.ndarray) -> np.ndarray:
    tables = _tables(p, x.vectors(p))
    return np.concatenate([1 / (1 + np.exp(-_forward(p, tables, ids[:, s : s + _BLOCK], x.n))) for s in range(0, ids.shape[1], _BLOCK)])


def window_scores(p: dict, texts: pa.Array, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word within the text, and probability of every window."""
    w = words(texts)
    x = Inputs(w, p.get("known"))
    doc, start, end = windows(w, window, stride)
    tables = _tables(p, x.vectors(p))
    prob = np.zeros(len(doc), np.float32)
    for s in range(0, len(doc), _BLOCK):
        ids = _ids(x, start[s : s + _BLOCK], end[s : s + _BLOCK], window)
        prob[s : s + _BLOCK] = 1 / (1 + np.exp(-_forward(p, tables, ids, x.n)))
    return doc, start - w.first[doc], prob


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    return fit(labelled(documents, labels, "toxic", per_class))


def score(df: DataFrame, p: dict | None, threshold: float | None = None, window: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """Every row of df(doc_id, text): windows scored, the worst score, toxic or not, and where the toxic windows begin."""

    limit = threshold if threshold is not None else p["threshold"] if p else THRESHOLD

    def run(batches):
        for b in slice_batches(batches):
            n = b.num_rows
            doc, at, prob = window_scores(p, b.column("text"), window, stride) if p else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            count = np.bincount(doc, minlength=n)
            first = np.r_[0, np.cumsum(count)]
            worst = np.full(n, np.nan)
            has = count > 0
            if has.any():
                worst[has] = np.maximum.reduceat(prob, first[:-1][has])
            hit = prob >= limit
            hits = np.bincount(doc[hit], minlength=n)
            where = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(hits)], pa.int32()), pa.array(at[hit], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(count, pa.int32()), pa.array(worst, mask=~has), pa.array(hits > 0), pa.array(hits, pa.int32()), where],
                ["doc_id", "windows", "score", "toxic", "toxic_windows", "toxic_at"],
            )

    return docs_only(df).mapInArrow(run, "doc_id long, windows int, score double, toxic boolean, toxic_windows int, toxic_at array<int>")


def op3_toxic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a toxic window, with the number, worst score and places of their windows."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels"))).filter("toxic")
