"""Operator 6, suffix-array dedup: distributed prefix doubling.

Suffixes begin at words.  Their first ranks are those of their first SYMBOL words;
each round Spark sorts the pairs (rank at p, rank at p + offset) and reranks, so that
equal ranks mean equal prefixes of twice the length, until LEAST words are covered.
Positions whose rank is unique leave at every round; equal ranks after the last
round are passages of LEAST words that occur again.

Only positions that can still repeat enter the first sort: two equal passages of
LEAST words select the same anchor (the least hash of SYMBOL words within), so a
passage whose anchor occurs once in the corpus is unique.  That test is exact.
Documents of equal words are sorted once; their copies are repeated as a whole.

A sort partitions by a range of the ranks, so a new rank, partition and place in it,
keeps the order of the suffixes and needs no global numbering.  Of a pair that more
than HOT rows of one batch have, two go to its own partition, to be told from unique
ones and to tell others, and the rest, which repeat for certain, are spread over all
partitions; as those can't know its place, the rank of such a pair is a hash, below all
others.  So a passage that a third of the corpus shares loads no single task.

Defined results
- null, empty and short texts (under LEAST words): no passages;
- very long texts: all their suffixes; passages that repeat within one document only
  count too; overlapping passages are merged, ties are equal passages;
- repeated rows: a row that repeats a doc_id and its text is the same document; other
  texts under the same doc_id are other documents, reported under that id;
- rows with a null doc_id: left out; empty table: no rows; other columns: ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IdFilter, cut, docs_only, parts, table
from .kernels import Words, mix, ngrams, slice_batches, slices, words

#: Words of a passage that must occur again.
LEAST = 50
#: Words in a first rank.
SYMBOL = 13
#: A pair of ranks is spread by a batch in which it has more rows than this.
HOT = 16
_LOW = np.uint64((1 << 20) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: hot: 0, or 1 for the rows of a hot pair that go to its own partition, 2 for those that are spread.
_PAIRS = "uid long, pos int, r1 long, r2 long, hot byte"


def _text_hash(w: Words) -> np.ndarray:
    """One hash for each text's sequence of words."""
    m = len(w.hash)
    base = pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    local = np.arange(m) - np.repeat(w.first[:-1], np.diff(w.first))
    powers = np.ones(int(local.max()) + 1 if m else 1, np.uint64)
    powers[1:] = np.uint64(base)
    powers = np.multiply.accumulate(powers)
    run = np.zeros(m + 1, np.uint64)
    np.cumsum(w.hash * powers[local], out=run[1:])
    return mix(run[w.first[1:]] - run[w.first[:-1]] + np.diff(w.first).astype(np.uint64))


def _symbols(w: Words, symbol: int) -> np.ndarray:
    """Hash of the symbol words from each word on; 0 where the text has too few left."""
    out = np.zeros(len(w.hash), np.uint64)
    h, at = ngrams(w, symbol)
    ok = np.repeat(w.first[1:], np.diff(w.first))[at] - at >= symbol
    out[at[ok]] = h[ok]
    return out


def _anchors(w: Words, h: np.ndarray, least: int, symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all passages of ``least`` words, and the anchor of each."""
    n = len(h)
    start = np.flatnonzero(np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n) >= least)
    if not len(start):
        return start, start
    key = (h & ~_LOW) | (np.uint64(n) - np.arange(n, dtype=np.uint64) & _LOW)
    width, step = least - symbol + 1, 1
    while 2 * step <= width:
        key[: n - step] = np.minimum(key[: n - step], key[step:])
        step *= 2
    low = np.minimum(key[start], key[start + width - step]) & _LOW
    return start, start + ((np.uint64(n) - low - start.astype(np.uint64)) & _LOW).astype(np.int64)


def _lists(w: Words, at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, w.first), pa.int32()), pa.array(values, kind))


def anchored(df: DataFrame, least: int = LEAST, symbol: int = SYMBOL) -> DataFrame:
    """doc_id, text_id, words, anchors and their places for each document of at least ``least`` words."""

    def run(batches):
        for b in slice_batches(batches):
            w = words(b.column("text"))
            h = _symbols(w, symbol)
            at = np.unique(_anchors(w, h, least, symbol)[1])
            n = np.diff(w.first)
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(_text_hash(w).view(np.int64)), pa.array(n, pa.int32()), _lists(w, at, h[at].view(np.int64), pa.int64()), _lists(w, at, at - w.first[np.searchsorted(w.first, at, "right") - 1], pa.int32())],
                ["doc_id", "text_id", "words", "anchors", "places"],
            )
            yield out.filter(pa.array(n >= least))

    return docs_only(df).filter("doc_id is not null").mapInArrow(run, "doc_id long, text_id long, words int, anchors array<long>, places array<int>")


def _first_pairs(docs: DataFrame, least: int, symbol: int, offset: int) -> DataFrame:
    """uid, pos and the first pair of ranks of all positions within passages that may repeat; docs(uid, text, places)."""

    def run(batches):
        for b in slice_batches(batches):
            w = words(b.column("text"))
            h = _symbols(w, symbol)
            start, anchor = _anchors(w, h, least, symbol)
            lists = b.column("places")
            seen = np.zeros(len(h) + 1, bool)
            seen[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(w.first[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))] = True
            start = start[seen[anchor]]
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + least - symbol - offset + 1, -1)
            pos = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            doc = np.searchsorted(w.first, pos, "right") - 1
            yield _pair_rows(b.column("uid").take(pa.array(doc)), pos - w.first[doc], h[pos].view(np.int64), h[pos + offset].view(np.int64), HOT)

    return docs.mapInArrow(run, _PAIRS)


def _pair_rows(uid: pa.Array, pos: np.ndarray, r1: np.ndarray, r2: np.ndarray, most: int) -> pa.RecordBatch:
    """Rows of _PAIRS; a pair with more than most of them is hot."""
    key = _hashed(r1, r2)
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]]) if len(order) else order
    size = np.diff(np.r_[edge, len(order)])
    hot = np.zeros(len(order), np.int8)
    hot[order] = np.where(np.repeat(size > most, size), np.where(np.arange(len(order)) - np.repeat(edge, size) < 2, 1, 2), 0)
    return pa.RecordBatch.from_arrays([uid, pa.array(pos, pa.int32()), pa.array(r1), pa.array(r2), pa.array(hot)], ["uid", "pos", "r1", "r2", "hot"])


def _hashed(r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """The rank of hot pairs, negative."""
    return (mix(mix(r1.view(np.uint64)) * _STEP + r2.view(np.uint64)) | np.uint64(1 << 63)).view(np.int64)


def _rerank(pairs: DataFrame, part) -> DataFrame:
    """uid, pos and rank of the positions whose pair occurs again; one row is held back, however many are equal.

    part gives the partition of a pair's own; hot rows come first among those of their pair there.
    """
    n = parts(pairs.sparkSession) * 2
    to = F.when(F.col("hot") == 2, F.pmod(F.xxhash64("uid", "pos"), F.lit(n)).cast("int")).otherwise(part(n))
    order = pairs.repartitionById(n, to).sortWithinPartitions("r1", "r2", F.desc("hot"))
    names = ("uid", "pos", "r1", "r2", "hot")

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        held, seen, group, hashed = None, False, -1, False  # the last row, whether equal ones were before it, its pair's place, and whether that is hot
        for b in batches:
            if not b.num_rows:
                continue
            t = {k: b.column(k).to_numpy() for k in names}
            if held is not None:
                t = {k: np.concatenate([held[k], t[k]]) for k in names}
            same = (t["r1"][1:] == t["r1"][:-1]) & (t["r2"][1:] == t["r2"][:-1])
            edge = np.flatnonzero(np.r_[True, ~same])
            size = np.diff(np.r_[edge, len(t["uid"])])
            own = np.arange(len(edge)) + (group if held is not None else group + 1)
            hot = t["hot"][edge] > 0
            hot[0] |= held is not None and hashed
            before = np.r_[seen, same]
            keep = before | np.r_[same, False] | (t["hot"] == 2)
            rank = np.where(np.repeat(hot, size), _hashed(t["r1"], t["r2"]), base + np.repeat(own, size))
            held, seen, group, hashed, last = {k: v[-1:] for k, v in t.items()}, bool(before[-1]), int(own[-1]), bool(hot[-1]), rank[-1:]
            yield emit({k: v[:-1][keep[:-1]] for k, v in t.items()}, rank[:-1][keep[:-1]])
        if held is not None and (seen or held["hot"][0] == 2):
            yield emit(held, last)

    def emit(t, rank):
        return pa.RecordBatch.from_arrays([pa.array(t["uid"]), pa.array(t["pos"], pa.int32()), pa.array(rank)], ["uid", "pos", "rank"])

    return order.mapInArrow(run, "uid long, pos int, rank long")


def _by_document(ranks: DataFrame, work, fields: str) -> DataFrame:
    """work(uid, pos, rank) on whole documents, rows in reading order."""

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = [b.column(k).to_numpy() for k in ("uid", "pos", "rank")]
            if rest is not None:
                t = [np.concatenate([x, y]) for x, y in zip(rest, t)]
            last = int(np.searchsorted(t[0], t[0][-1], "left"))
            rest = [x[last:] for x in t]
            if last:
                yield work(*(x[:last] for x in t))
        if rest is not None:
            yield work(*rest)

    return ranks.repartition(parts(ranks.sparkSession), "uid").sortWithinPartitions("uid", "pos").mapInArrow(run, fields)


def _pairs(offset: int):
    def work(uid, pos, rank):
        code = np.cumsum(np.r_[0, uid[1:] != uid[:-1]]).astype(np.int64) << 32 | pos
        to = np.minimum(np.searchsorted(code, code + offset), len(code) - 1)
        ok = code[to] == code + offset
        return _pair_rows(pa.array(uid[ok]), pos[ok], rank[ok], rank[to[ok]], HOT)

    return work


def _intervals(least: int):
    def work(uid, pos, rank):
        new = np.flatnonzero(np.r_[True, (uid[1:] != uid[:-1]) | (pos[1:] > pos[:-1] + least)])
        last = np.r_[new[1:] - 1, len(uid) - 1]
        return pa.RecordBatch.from_arrays([pa.array(uid[new]), pa.array(pos[new], pa.int32()), pa.array(pos[last] + least, pa.int32())], ["uid", "first_word", "end_word"])

    return work


def repeated(df: DataFrame, least: int = LEAST, symbol: int = SYMBOL) -> DataFrame:
    """doc_id, first_word, end_word and words of every maximal stretch of passages that occur again."""
    symbol = min(symbol, -(-least // 2))
    docs = cut(anchored(df, least, symbol))
    texts = docs.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("copies"), F.first("anchors").alias("anchors"), F.first("places").alias("places"))
    entry = texts.select("doc_id", "text_id", F.explode(F.arrays_zip("anchors", "places")).alias("e")).select("doc_id", "text_id", F.col("e.anchors").alias("anchor"), F.col("e.places").alias("place"))
    again = entry.join(entry.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchor", "left_semi")
    hot = cut(again.groupBy("doc_id", "text_id").agg(F.collect_list("place").alias("places")).withColumn("uid", F.monotonically_increasing_id()))
    needed = IdFilter(hot.select("doc_id").distinct())

    def wanted(batches):
        for b in slice_batches(batches):
            b = b.filter(pa.array(needed.maybe(b.column("doc_id").to_numpy())))
            yield b.append_column("text_id", pa.array(_text_hash(words(b.column("text"))).view(np.int64)))

    whole = docs_only(df).filter("doc_id is not null").mapInArrow(wanted, "doc_id long, text string, text_id long")
    source = whole.dropDuplicates(["doc_id", "text_id"]).join(hot, ["doc_id", "text_id"]).select("uid", "text", "places")

    length, offset = symbol, min(symbol, least - symbol)
    pairs = _first_pairs(source, least, symbol, offset)
    part = lambda n: F.shiftright(F.shiftrightunsigned("r1", 33) * n, 31).cast("int")
    while True:
        length += offset
        ranks = _rerank(pairs, part)
        if length >= least:
            break
        offset = min(length, least - length)
        part = lambda n: F.when(F.col("r1") < 0, F.pmod(F.xxhash64("r1"), F.lit(n))).otherwise(F.shiftright("r1", 33)).cast("int")
        pairs = _by_document(ranks, _pairs(offset), _PAIRS)
    found = _by_document(ranks, _intervals(least), "uid long, first_word int, end_word int")

    copied = texts.filter("copies > 1").select("text_id")
    passages = found.join(hot.select("uid", "text_id"), "uid").join(copied, "text_id", "left_anti").join(docs.select("doc_id", "text_id").distinct(), "text_id").select("doc_id", "first_word", "end_word")
    copies = docs.join(copied, "text_id", "left_semi").select("doc_id", F.lit(0).alias("first_word"), F.col("words").alias("end_word")).distinct()
    return passages.unionByName(copies).withColumn("words", F.col("end_word") - F.col("first_word"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least LEAST words that occur more than once in the documents."""
    return repeated(table(spark, sf_dir, "documents"))
