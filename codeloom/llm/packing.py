"""Operator 8, best-fit packing: large-item matching.

Documents are packed into bins of CAPACITY tokens of a vocabulary, counted exactly by
operator 4.  Pieces above a third of it are
large: no three fit together, so each is matched greedily, from the largest down,
with the largest other one that still fits.  Smaller pieces then go, from the
largest down, each into the tightest gap that holds it.  A document longer than a
bin fills whole bins first and is packed by its rest.

Shards of about SHARD documents, chosen by hash, are packed apart, so no task grows
with the corpus; bins half empty at a shard's end cost under one bin in a thousand.

Defined results
- a text of no characters, or null: no tokens and no piece;
- first_token, tokens and bin_offset: all in tokens, so no bin overflows;
- very long texts: cut, every piece reported; ties in size: by doc_id, nulls first,
  then by the order within the shard; repeated rows: each packed;
- empty table: no rows; other columns: ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_only, table
from .kernels import slice_batches
from .tokenizer import VOCABULARY, count_tokens

CAPACITY = 2048
SHARD = 20_000

_FIELDS = "bin_id long, doc_id long, piece int, first_token long, tokens int, bin_offset int"


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sizes, at most capacity, come from the largest down."""
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    large = next((k for k, n in enumerate(sizes) if 3 * n <= capacity), len(sizes))
    gaps: list[tuple[int, int]] = []  # (gap, bin), ascending
    left = [-k for k in range(large - 1, -1, -1)]  # unmatched large pieces, the smallest first
    size = lambda minus: sizes[-minus]
    bins = 0
    while left:
        k = -left.pop()  # the largest
        place[k] = (bins, 0)
        gap = capacity - sizes[k]
        to = bisect_right(left, gap, key=size)
        if to:
            # the largest that fits; among ties the one that comes first
            j = -left.pop(to - 1)
            place[j] = (bins, sizes[k])
            gap -= sizes[j]
        if gap:
            gaps.append((gap, bins))
        bins += 1
    gaps.sort()
    for k in range(large, len(sizes)):
        at = bisect_left(gaps, (sizes[k], -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b, bins = capacity, bins, bins + 1
        place[k] = (b, capacity - gap)
        if gap > sizes[k]:
            insort(gaps, (gap - sizes[k], b))
    return place


def _counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, tokens and mark of docs(doc_id, text, mark)."""

    def run(batches):
        for b in slice_batches(batches):
            tokens, _ = count_tokens(b.column("text"), vocabulary)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tokens, pa.int64()), b.column("mark")], ["doc_id", "tokens", "mark"])

    return docs.mapInArrow(run, "doc_id long, tokens long, mark long")


def packed(df: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, vocabulary: str = VOCABULARY) -> DataFrame:
    """bin_id, doc_id, piece, first_token, tokens and bin_offset of every piece of df(doc_id, text), sizes in tokens of the vocabulary."""
    items = _counted(docs_only(df).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("mark")), vocabulary).filter("tokens > 0")
    shards = max(1, -(-df.count() // shard))

    def run(key, t):
        # in one order, however the rows arrived
        t = t.sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        doc = t.column("doc_id").combine_chunks()
        ids, null = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)
        n = t.column("tokens").to_numpy()
        whole = n // capacity
        rest = n - whole * capacity
        order = np.lexsort((t.column("mark").to_numpy(), ids, ~null, -rest))
        order = order[rest[order] > 0]
        place = np.array(pack(rest[order].tolist(), capacity), np.int64).reshape(-1, 2)
        used = int(place[:, 0].max()) + 1 if len(place) else 0
        full = np.repeat(np.arange(len(n)), whole)
        k = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
        row = np.r_[order, full]
        base = key[0].as_py() << 32
        return pa.table([
            pa.array(base + np.r_[place[:, 0], used + np.arange(len(full))]), doc.take(pa.array(row)), pa.array(np.r_[whole[order], k], pa.int32()), pa.array(np.r_[whole[order], k] * capacity, pa.int64()),
            pa.array(np.r_[rest[order], np.full(len(full), capacity)], pa.int32()), pa.array(np.r_[place[:, 1], np.zeros(len(full), np.int64)], pa.int32()),
        ], ["bin_id", "doc_id", "piece", "first_token", "tokens", "bin_offset"])

    return items.groupBy(F.pmod(F.col("mark"), F.lit(shards)).alias("shard")).applyInArrow(run, _FIELDS)


def op8_best_fit_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of CAPACITY tokens of the vocabulary."""
    return packed(table(spark, sf_dir, "documents"))
