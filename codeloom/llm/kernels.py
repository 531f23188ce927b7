"""Vectorised text kernels shared by the corpus operators.

Everything here works on one Arrow batch at a time, inside ``mapInArrow``: texts
become one flat byte array, and words, word n-grams and per-document sets are
numpy arrays over it.  No kernel loops over rows or words in Python.

A *word* is a maximal run of ASCII letters, digits, ``_`` and non-ASCII bytes of
the lower-cased text, so words never depend on the batch they came in.
A null text counts as an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_NGRAM = np.uint64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_POWERS = {"n": 0, "pow": None, "inv": None}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("pow", _BASE), ("inv", _BASE_INV)):
            a = np.empty(size, np.uint64)
            a[0] = 1
            done = 1
            while done < size:
                take = min(done, size - done)
                a[done : done + take] = a[:take] * np.uint64(pow(base, done, 1 << 64))
                done += take
            _POWERS[name] = a
        _POWERS["n"] = size
    return _POWERS["pow"], _POWERS["inv"]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n+1 offsets of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of a batch in reading order; ``first[d]:first[d+1]`` are those of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in mask; no run crosses a text's end."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=edge[1:n])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    inner = np.unique(cut[mask[cut] & mask[cut - 1]])
    at = np.flatnonzero(edge)
    if len(inner):
        at = np.sort(np.concatenate([at, inner, inner]))
    return at[0::2], at[1::2]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one running polynomial."""
    n = len(data)
    pw, inv = _powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=run[1:])
    return mix((run[end] - run[start]) * inv[start] + (end - start).astype(np.uint64) * _NGRAM)


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Words of all texts of a batch with their hashes."""
    data, off = flat(pc.utf8_lower(texts) if lower else texts)
    start, end = spans(_WORD[data], off)
    return Words(data, off, start, end, span_hash(data, start, end), np.searchsorted(start, off, "left"))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and the word at which each starts, in reading order.

    No n-gram crosses a text's end.  A text of 1 to n-1 words has one, of all its words.
    """
    m = len(w.hash)
    if m == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.diff(w.first)
    h = np.zeros(m, np.uint64)
    for k in range(min(n, m)):
        h[: m - k] = h[: m - k] * _NGRAM + w.hash[k:]
    at = np.arange(m)
    left = np.repeat(w.first[1:], size) - at
    short = np.flatnonzero((size > 0) & (size < n))
    keep = left >= n
    keep[w.first[short]] = True
    if len(short):
        f, s, x = w.first[short], size[short], np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            live = s > k
            x[live] = x[live] * _NGRAM + w.hash[f[live] + k]
        h[f] = x ^ s.astype(np.uint64)
    at = at[keep]
    return mix(h[at]), at


def doc_sets(w: Words, n: int, bits: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of n-gram hashes: sorted unique values, and the n+1 offsets."""
    h, at = ngrams(w, n)
    docs = len(w.first) - 1
    if docs >= 1 << (64 - bits):
        raise ValueError(f"at most {(1 << (64 - bits)) - 1} texts a batch")
    d = np.searchsorted(w.first, at, "right") - 1
    key = (d.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits))
    key.sort()
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    first = np.searchsorted(key, np.arange(docs + 1, dtype=np.uint64) << np.uint64(bits))
    return key & np.uint64((1 << bits) - 1), first


def fold(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One uint64 for each slice of values, from all of it and its length."""
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values), out=run[1:])
    x = run[first[1:]] - run[first[:-1]]
    np.bitwise_xor.accumulate(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=run[1:]) if len(values) else None
    y = run[first[1:]] ^ run[first[:-1]]
    return mix(x * _NGRAM + y + np.diff(first).astype(np.uint64))


def slices(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indices of all ranges first[i]:last[i] end to end."""
    n = last - first
    n = np.maximum(n, 0)
    total = int(n.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    ok = n > 0
    f, m = first[ok], n[ok]
    begin = np.r_[0, np.cumsum(m)[:-1]]
    out[0] = f[0]
    out[begin[1:]] = f[1:] - (f[:-1] + m[:-1] - 1)
    return np.cumsum(out)


def slice_batches(batches, rows: int = 4096, size: int = 1 << 20):
    """Record batches cut to at most ``rows`` rows and, beyond one row, about ``size`` bytes of text."""
    for b in batches:
        if b.num_rows == 0:
            continue
        cum = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = cum[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(cum, base + size, "right"))))
            yield b.slice(at, to - at)
            at = to
