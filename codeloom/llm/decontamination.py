"""Operator 9, benchmark decontamination: template canonicalisation.

Numbers, names and units become typed placeholders, so a re-parameterised question
has the template windows of the original.  A capitalised word that begins a sentence,
line or quotation may be a name or not, so windows over such words are indexed in both
readings, literal and as names.  Windows of both sides are hash-joined;
a document is contaminated by an item when enough of the item's windows occur in it
and the values in the placeholders map one to one from the item's to the document's,
both judged for each occurrence of the item on its own.

The benchmark side is the small one and is sent to every task in parts of at most
PART_WINDOWS windows, both readings counted; a larger benchmark takes more passes over the documents, never
a larger broadcast.

Defined results
- null or empty text, on either side: no windows, never contaminated;
- items of fewer than WINDOW tokens: one window of all their tokens; of fewer than
  LEAST_TOKENS: no windows, as chance repeats them;
- items all of whose windows have too many placeholders, as arithmetic and tables:
  joined on the values instead, so copies with the same values are found and
  re-parameterised ones are not;
- very long texts: all windows; repeated rows: each judged, the report has them once;
- null doc_id or item_id: judged and reported as such;
- several items in a document: one report row for each; several occurrences of an item:
  the row is that of the one with the most windows of one alignment that passes, of ties
  the earliest; empty tables: no rows;
- other columns: ignored in report(), passed through in clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_only, table
from .kernels import _WORD, Words, flat, ngrams, slice_batches, slices, span_hash, spans

WINDOW = 8
LEAST_TOKENS = 4
#: Share of an item's windows that a document must hold.
LEAST_COVERAGE = 0.4
#: Windows with more placeholders than this share say too little to count.
MOST_SLOTS = 0.5
#: Share of placeholder pairs that must agree with a one-to-one mapping.
LEAST_CONSISTENT = 0.8
PART_WINDOWS = 1_000_000

NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNIT_WORDS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent meter meters metre metres kilometer kilometers degree degrees".split()
_NUM, _NAME, _UNIT = (np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in (3, 5, 7))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\n\"'("]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 13, 32]] = True


def _hashes(values: list[str]) -> np.ndarray:
    data, off = flat(pa.array(values, pa.string()))
    return span_hash(data, off[:-1], off[1:])


def templates(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Canonical tokens of each text, the type of each (0 literal, 1 number, 2 name, 3 unit) and the hash of its value."""
    return _templates(texts)[:3]


def _templates(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Those, and which literals begin a sentence and may be names."""
    data, off = flat(texts)
    digit = _DIGIT[data]
    mask = _WORD[data].copy()
    if len(data) > 2:
        point = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        mask[1:-1] |= point
    start, end = spans(mask, off)
    first = np.searchsorted(start, off, "left")
    lowered = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
    value = span_hash(lowered, start, end)
    kind = np.zeros(len(start), np.int8)
    maybe = np.zeros(len(start), bool)
    if len(start):
        upper = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_UPPER[data], out=upper[1:])
        # the last byte before the token that isn't blank decides whether a sentence begins here
        solid = np.where(~_BLANK[data], np.arange(len(data)), -1)
        np.maximum.accumulate(solid, out=solid)
        before = np.where(start > 0, solid[np.maximum(start - 1, 0)], -1)
        inner = (before >= np.repeat(off[:-1], np.diff(first))) & (before >= 0)
        begins = ~inner | _END[data[np.maximum(before, 0)]]
        # one capital, or more after a small letter, as in McDonald
        name = _UPPER[data[start]] & (end - start > 1) & ((upper[end] - upper[start] == 1) | _LOWER[data[np.minimum(start + 1, end - 1)]])
        kind[name & ~begins] = 2
        kind[digit[start] | np.isin(value, _hashes(NUMBER_WORDS))] = 1
        unit = np.isin(value, _hashes(UNIT_WORDS))
        unit[1:] &= kind[:-1] == 1
        unit[0] = False
        unit[first[:-1][first[:-1] < len(unit)]] = False
        kind[unit] = 3
        maybe = name & begins & (kind == 0)
    h = np.where(kind == 0, value, np.choose(kind, [np.uint64(0), _NUM, _NAME, _UNIT]))
    return Words(data, off, start, end, h, first), kind, value, maybe


def template_windows(w: Words, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window of n tokens with few enough placeholders; none for shorter texts."""
    h, at = ngrams(w, n)
    slots = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(kind > 0, out=slots[1:])
    size = np.diff(w.first)
    doc = np.searchsorted(w.first, at, "right") - 1
    ok = size[doc] >= n
    last = np.minimum(at + n, len(kind))
    ok &= slots[last] - slots[at] <= MOST_SLOTS * n
    return h[ok], at[ok]


def _readings(w: Words, kind: np.ndarray, maybe: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """template_windows(), and then those with words that may be names, read as names."""
    h, at = template_windows(w, kind, n)
    if not maybe.any():
        return h, at
    names = replace(w, hash=np.where(maybe, _NAME, w.hash))
    h2, at2 = template_windows(names, np.where(maybe, np.int8(2), kind), n)
    some = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(maybe, out=some[1:])
    has = some[np.minimum(at2 + n, len(kind))] > some[at2]
    return np.r_[h, h2[has]], np.r_[at, at2[has]]


def _literal_windows(w: Words, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the values and first token of each window of n tokens; none for shorter texts."""
    h, at = ngrams(replace(w, hash=value), n)
    ok = np.diff(w.first)[np.searchsorted(w.first, at, "right") - 1] >= n
    return h[ok], at[ok]


class Index:
    """Template windows of some benchmark items, sorted by hash, for each window length."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        w, self.kind, self.value, self.maybe = _templates(pa.array(texts, pa.string()))
        self.ids = ids
        self.size = size = np.diff(w.first)
        length = np.where(size >= window, window, np.where(size >= LEAST_TOKENS, size, 0))
        self.total = np.zeros(len(ids), np.int64)
        #: by the window's length and whether it is joined on values
        self.by_length: dict[tuple[int, bool], tuple] = {}
        for n in sorted({int(x) for x in length} - {0}):
            left = length == n
            for literal in (False, True):
                h, at = _literal_windows(w, self.value, n) if literal else _readings(w, self.kind, self.maybe, n)
                item = np.searchsorted(w.first, at, "right") - 1
                ok = left[item]
                h, at, item = h[ok], at[ok], item[ok]
                if len(h):
                    order = np.argsort(h, kind="stable")
                    self.by_length[n, literal] = (h[order], at[order], item[order], _bits(h))
                    self.total += np.bincount(np.searchsorted(w.first, np.unique(at), "right") - 1, minlength=len(ids))
                left &= self.total == 0
        self.windows = sum(len(x[0]) for x in self.by_length.values())


def _bits(h: np.ndarray) -> np.ndarray:
    """A bitmap over 20 bits of the hashes, which spares most windows the search."""
    seen = np.zeros(1 << 20, bool)
    seen[(h >> np.uint64(44)).astype(np.int64)] = True
    return seen


def _match(index: Index, texts: pa.Array) -> list[tuple[int, int, float, int, int, float]]:
    """(text, item, coverage, first token, past-the-end token, consistent share) for each contaminated pair."""
    w, kind, value, maybe = _templates(texts)
    found = []
    for (n, literal), (h, at, item, seen) in index.by_length.items():
        dh, dat = _literal_windows(w, value, n) if literal else _readings(w, kind, maybe, n)
        hit = seen[(dh >> np.uint64(44)).astype(np.int64)]
        dh, dat = dh[hit], dat[hit]
        lo, hi = np.searchsorted(h, dh, "left"), np.searchsorted(h, dh, "right")
        times = hi - lo
        k = slices(lo, hi)
        found.append(np.column_stack([np.repeat(dat, times), at[k], item[k], np.full(len(k), n)]))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    if not len(rows):
        return []
    doc = np.searchsorted(w.first, rows[:, 0], "right") - 1
    order = np.lexsort((rows[:, 0], rows[:, 2], doc))
    rows, doc = rows[order], doc[order]
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rows[1:, 2] != rows[:-1, 2])])
    out = []
    for s, e in zip(edge, np.r_[edge[1:], len(rows)]):
        r = rows[s:e]
        if len(np.unique(r[:, 1])) < LEAST_COVERAGE * index.total[r[0, 2]]:
            continue
        for o in _occurrences(r, int(index.size[r[0, 2]])):
            i, n = int(o[0, 2]), int(o[0, 3])
            cover = len(np.unique(o[:, 1])) / index.total[i]
            if cover >= LEAST_COVERAGE and (share := _consistent(index, value, o)) >= LEAST_CONSISTENT:
                d = int(doc[s])
                out.append((d, i, float(cover), int(o[:, 0].min() - w.first[d]), int(o[:, 0].max() + n - w.first[d]), share))
                break
    return out


def _occurrences(r: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Ways to read the matches of an item of size tokens in a document as one occurrence, the likeliest first.

    Around each alignment (document token minus item token), the most frequent first,
    each item window keeps its match of the nearest alignment, within the item's length,
    then half of it and so on down to that alignment alone.  All matches together come
    last, for items whose parts stand far from each other.
    """
    shift = r[:, 0] - r[:, 1]
    order = np.argsort(shift, kind="stable")
    sorted_ = shift[order]
    at, n = np.unique(sorted_, return_counts=True)
    for a in at[np.argsort(-n, kind="stable")]:
        most, seen = size, -1
        while True:
            near = order[np.searchsorted(sorted_, a - most, "left") : np.searchsorted(sorted_, a + most, "right")]
            if len(near) != seen:
                seen, off = len(near), np.abs(shift[near] - a)
                near = near[np.lexsort((r[near, 0], off, r[near, 1]))]
                item = r[near, 1]
                yield r[near[np.r_[True, item[1:] != item[:-1]]]]
            if not most:
                break
            most //= 2
    yield r


def _consistent(index: Index, value: np.ndarray, r: np.ndarray) -> float:
    """Share of the placeholder pairs of some matches that agree with a one-to-one mapping."""
    here, there = np.unique((r[:, [1, 0]][:, None, :] + np.arange(int(r[0, 3]))[None, :, None]).reshape(-1, 2), axis=0).T
    a, b = index.value[here], value[there]
    slot = (index.kind[here] > 0) | (index.maybe[here] & (a != b))
    # a word that stands for a name elsewhere does so where it begins a sentence
    slot |= index.maybe[here] & np.isin(a, a[slot])
    if not slot.any():
        return 1.0
    a, b = a[slot], b[slot]
    return min(_single(a, b), _single(b, a))


def _single(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the pairs that stay when each value of a keeps its most frequent partner in b."""
    pairs, n = np.unique(np.column_stack([a, b]), axis=0, return_counts=True)
    edge = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
    return float(np.maximum.reduceat(n, edge).sum() / n.sum())


def indexes(benchmark: DataFrame, window: int = WINDOW, part: int = PART_WINDOWS) -> Iterator[Index]:
    """The benchmark in parts of bounded size, streamed through the driver."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        tokens = len(r.text or "") + 2  # an upper bound of the windows, in both readings
        if ids and size + tokens > part:
            yield Index(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += tokens
    if ids:
        yield Index(ids, texts, window)


def report(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, coverage, first_token, end_token and consistent of each contaminated pair."""
    item = benchmark.schema["item_id"].dataType
    fields = f"doc_id long, item_id {item.simpleString()}, coverage double, first_token int, end_token int, consistent double"
    spark, docs, out = df.sparkSession, docs_only(df), None
    for index in indexes(benchmark, window):
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in slice_batches(batches):
                rows = _match(sent.value, b.column("text"))
                ids = b.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([sent.value.ids[r[1]] for r in rows], _arrow(item)), *(pa.array([r[k] for r in rows], t) for k, t in ((2, pa.float64()), (3, pa.int32()), (4, pa.int32()), (5, pa.float64())))],
                    ["doc_id", "item_id", "coverage", "first_token", "end_token", "consistent"],
                )

        part = docs.mapInArrow(run, fields)
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else spark.createDataFrame([], fields)).distinct()


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of df, with all its columns, that no item contaminates."""
    for index in indexes(benchmark, window):
        sent = df.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in slice_batches(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in _match(sent.value, b.column("text"))]] = False
                yield b.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other numbers, names or units."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
