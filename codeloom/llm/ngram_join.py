"""Operator 2, n-gram Jaccard join: T-occurrence search by DivideSkip.

Two documents join when the Jaccard coefficient of their sets of word n-grams is at
least THRESHOLD.  Documents with equal sets are searched as one.  The search has two
levels, both T-occurrence problems:

1. over the corpus: the inverted lists of each set's SKETCH least n-gram hashes, which
   are all of a set that is no larger.  Two sets that join must meet on T lists, a
   number that follows from their sizes (see occurrences()): exact between two small
   sets, else the mean of a hypergeometric count less SLACK, so that a pair at the
   threshold is missed with a probability under 3e-7 (Hoeffding).
   A set that meets others on too few lists leaves.  Of the rest a set's longest
   lists, fewer than its least T, are left out (DivideSkip's long lists), the others
   merged, and a pair that still meets on T less those is a candidate.  A list's sets
   first meet its heaviest one alone, which takes as many rows as the list has and
   connects groups of near copies; then all pairs of sets that are not connected yet;
2. among the sets that candidates connect: inverted lists of their full sets.  For
   each query the short lists are merged, candidates reaching T - L go on, the L long
   lists are probed by binary search and overlaps at the exact bound stay.

No task holds an unbounded group.  N-grams that many texts of a batch share are spread
over all partitions; long lists are split into CHUNK sets and large components into
CHUNK_GRAMS n-grams, and every pair of such chunks is a group of its own.

Defined results
- join(): one row for each document that joins another, with class_id, the least doc_id
  of the documents that it joins directly or through others, and links, the number of
  documents that it joins itself; equal sets join.  Documents that join none: no row;
- null or empty text: no n-grams, no partners; texts of fewer than N words: one n-gram
  of all their words, so they join only texts of the same words;
- very long texts: their whole sets; ties and repeated rows: rows that repeat a doc_id
  and its n-grams are one document; another text under the same doc_id is another
  document, reported under that id; rows with a null doc_id join nothing;
- empty table: no rows; other columns: ignored in join(), passed through in keep_one();
- keep_one(): of each class the documents with the least doc_id stay, one row each;
  rows with a null doc_id all stay; of rows that repeat a doc_id the first by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IdFilter, cut, docs_only, fresh, parts, table
from .components import components
from .kernels import doc_sets, fold, mix, slice_batches, slices, words

N = 3
THRESHOLD = 0.5
SKETCH, SLACK = 128, 32
#: Of a set's least T, the share of lists that are left out.
SKIP = 0.9
#: The lists whose length is known, the longest ones; all others count as equally long.  16 bytes each are broadcast.
KNOWN_LISTS = 100_000
#: An n-gram is spread over the partitions by a batch in which this many texts, and this share of them, hold it.
SPREAD_TEXTS, SPREAD_SHARE = 32, 0.02
#: Sets of a list, and n-grams of a component, in one chunk; groups hold pairs of chunks.
CHUNK, CHUNK_GRAMS = 2048, 2_000_000
#: Entries that one task sorts, and bits of an n-gram's hash; tables hold them in six bytes each.
TASK_ENTRIES, BITS = 2_000_000, 48


def occurrences(size_a: np.ndarray, size_b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """T: the lists of their sketches on which two sets of these sizes meet, at least, if they join.

    They share t / (1 + t) of their sizes' sum, o.  Of the larger set's SKETCH least
    hashes a hypergeometric number, o / size on average, is shared; where that set's
    sketch ends first, the other sketch holds those too, and the same goes the other
    way round, so T is at least the lesser mean less SLACK.
    """
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    overlap = threshold / (1 + threshold) * (low + high)
    return np.where(high <= SKETCH, np.ceil(overlap - 1e-9), np.floor(SKETCH * overlap / np.maximum(high, 1) - SLACK)).astype(np.int64)


def least_occurrences(size: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The least T of a set of this size with any partner: one whose size is the threshold's share of the other's."""
    return np.maximum(1, np.minimum(np.ceil(threshold * np.asarray(size) - 1e-9), np.floor(SKETCH * threshold - SLACK))).astype(np.int64)


def skipped(size: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """How many of a set's longest lists are left out."""
    need = least_occurrences(size, threshold)
    return np.minimum(np.floor(SKIP * need).astype(np.int64), need - 1)


def _candidate(a, b, skip_a, skip_b, met, threshold: float) -> np.ndarray:
    """Whether sets of sizes a and b that meet on met lists, of those not left out, may join."""
    fits = (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
    return fits & (met >= np.maximum(1, occurrences(a, b, threshold) - np.maximum(skip_a, skip_b)))


def _packed(values: np.ndarray) -> np.ndarray:
    """Six bytes for each hash."""
    return np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _unpacked(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


def _blobs(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """One binary for each count of hashes."""
    data, at = _packed(values), np.r_[0, np.cumsum(count * 6)]
    return pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all binaries of a column, and how many each has."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return _unpacked(raw), np.diff(at) // 6


def sketches(df: DataFrame, n: int = N, k: int = SKETCH) -> DataFrame:
    """doc_id, set_id, size and the k least hashes of each document with an id and a word."""

    def run(batches):
        for b in slice_batches(batches):
            values, first = doc_sets(words(b.column("text")), n, BITS)
            size = np.diff(first)
            ok = np.flatnonzero(size > 0)
            take = np.minimum(size[ok], k)
            sets = fold(values, first)[ok].view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ok)), pa.array(sets), pa.array(size[ok], pa.int32()), _blobs(values[slices(first[ok], first[ok] + take)], take)], ["doc_id", "set_id", "size", "sketch"])

    return docs_only(df).filter("doc_id is not null").mapInArrow(run, "doc_id long, set_id long, size int, sketch binary")


def _met_lists(docs: DataFrame) -> DataFrame:
    """gram and set_id of the entries of lists that hold two sets or more.

    Each batch sends every partition one packed row: the entries of its lists, and the
    sets they name.  N-grams that many of a batch's sets hold are spread over all
    partitions; they are in two sets at least, so nothing needs to be counted.  The
    number of partitions follows from that of the entries.
    """
    total = docs.agg(F.sum(F.octet_length("sketch"))).first()[0] or 0
    n = max(parts(docs.sparkSession) // 2, -(-total // (6 * TASK_ENTRIES)), 1)

    def send(batches):
        for b in batches:
            set_id, at = np.unique(b.column("set_id").to_numpy(), return_index=True)
            gram, count = _hashes(b.column("sketch").take(pa.array(at)))
            owner = np.repeat(np.arange(len(at)), count)
            _, inverse, sets = np.unique(gram, return_inverse=True, return_counts=True)
            much = (sets >= max(SPREAD_TEXTS, SPREAD_SHARE * len(at)))[inverse]
            to = mix(np.where(much, gram ^ set_id[owner].view(np.uint64), gram)) % np.uint64(n)
            to = to.astype(np.int64) * 2 + much
            order = np.lexsort((owner, to))
            to, gram, owner = to[order], gram[order], owner[order]
            begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            new = np.r_[True, (owner[1:] != owner[:-1]) | (to[1:] != to[:-1])] if len(to) else np.zeros(0, bool)
            named = np.cumsum(new) - 1
            local = named - np.repeat(named[begin], np.diff(np.r_[begin, len(to)]))
            entries = np.diff(np.r_[begin, len(to)])
            own = np.add.reduceat(new, begin) if len(begin) else begin
            cuts = lambda count, width: pa.py_buffer(np.r_[0, np.cumsum(count * width)].astype(np.int32))
            binary = lambda data, count, width: pa.Array.from_buffers(pa.binary(), len(begin), [None, cuts(count, width), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[begin] // 2, pa.int32()), pa.array(to[begin] % 2 == 1), _blobs(gram, entries), binary(local.astype("<u2"), entries, 2), binary(set_id[owner[new]].astype("<i8"), own, 8)],
                ["to", "spread", "grams", "places", "sets"],
            )

    def read(batches):
        grams, sets, spreads = [], [], []
        for b in batches:
            for k in range(b.num_rows):
                own = np.frombuffer(b.column("sets")[k].as_buffer(), "<i8")
                grams.append(_unpacked(np.frombuffer(b.column("grams")[k].as_buffer(), np.uint8)))
                sets.append(own[np.frombuffer(b.column("places")[k].as_buffer(), "<u2")])
                spreads.append(np.full(len(grams[-1]), b.column("spread")[k].as_py()))
        if not grams:
            return
        gram, set_id, spread = np.concatenate(grams), np.concatenate(sets), np.concatenate(spreads)
        order = np.lexsort((spread, set_id, gram))
        gram, set_id, spread = gram[order], set_id[order], spread[order]
        # of equal entries the last stays, which is spread if any is
        last = np.r_[(gram[1:] != gram[:-1]) | (set_id[1:] != set_id[:-1]), True]
        gram, set_id, spread = gram[last], set_id[last], spread[last]
        same = gram[1:] == gram[:-1]
        keep = np.r_[False, same] | np.r_[same, False] | spread
        table = pa.table({"gram": pa.array(gram[keep].astype(np.int64)), "set_id": pa.array(set_id[keep])})
        yield from table.to_batches(max_chunksize=1 << 16)

    def sliced(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1 << 15):  # places are told in two bytes
                yield b.slice(at, 1 << 15)

    sent = docs.select("set_id", "sketch").mapInArrow(lambda batches: send(sliced(batches)), "to int, spread boolean, grams binary, places binary, sets binary")
    return sent.repartitionById(n, "to").mapInArrow(read, "gram long, set_id long")


def _searched(docs: DataFrame, threshold: float) -> DataFrame:
    """set_id, size and grams, the lists it meets others on, of the sets that meet others on as many lists as their least T."""
    size = docs.groupBy("set_id").agg(F.first("size").alias("size"))
    sets = _met_lists(docs).repartition("set_id").groupBy("set_id").agg(F.collect_set("gram").alias("grams"))
    need = F.greatest(F.lit(1), F.least(F.ceil(F.col("size") * threshold - 1e-9), F.lit(int(np.floor(SKETCH * threshold - SLACK)))))
    return cut(sets.join(size, "set_id").filter(F.size("grams") >= need))


def _known_lists(sets: DataFrame):
    """The KNOWN_LISTS longest lists and their lengths, sent to all tasks."""
    known = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(KNOWN_LISTS).toArrow().sort_by("gram")
    return sets.sparkSession.sparkContext.broadcast((known["gram"].to_numpy(), known["n"].to_numpy()))


def _merged_lists(sets: DataFrame, known, threshold: float) -> DataFrame:
    """gram, set_id, size, skip, weight and component of the entries that are merged: all but each set's longest lists.

    The weight of a set is the length of its known lists, so that in a group of near
    copies the most typical one has the greatest.
    """

    def run(batches):
        listed, length = known.value
        for b in batches:
            grams = b.column("grams")
            count = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            gram, owner = grams.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b.num_rows), count)
            long = np.zeros(len(gram), np.int64)
            if len(listed):
                at = np.minimum(np.searchsorted(listed, gram), len(listed) - 1)
                long = np.where(listed[at] == gram, length[at], 0)
            size = b.column("size").to_numpy().astype(np.int64)
            skip = skipped(size, threshold)
            weight = np.bincount(owner, long, b.num_rows).astype(np.int64)
            order = np.lexsort((gram, -long, owner))  # lists in the same order for every set
            place = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count)
            keep = order[place >= skip[owner]]
            of = owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram[keep]), b.column("set_id").take(pa.array(of)), pa.array(size[of], pa.int32()), pa.array(skip[of], pa.int32()), pa.array(weight[of]), b.column("component").take(pa.array(of))],
                ["gram", "set_id", "size", "skip", "weight", "component"],
            )

    return sets.select("set_id", "size", "grams", "component").mapInArrow(run, "gram long, set_id long, size int, skip int, weight long, component long")


def _meeting(pair: DataFrame, threshold: float) -> DataFrame:
    """a, b of the candidates among a, b, size_a, size_b, skip_a, skip_b and met, parts of the number of lists they meet on."""
    met = pair.groupBy("a", "b").agg(F.sum("met").alias("met"), *[F.first(c).alias(c) for c in ("size_a", "size_b", "skip_a", "skip_b")])

    def run(batches):
        for b in batches:
            column = lambda c: b.column(c).to_numpy().astype(np.int64)
            ok = _candidate(*(column(c) for c in ("size_a", "size_b", "skip_a", "skip_b", "met")), threshold)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return met.mapInArrow(run, "a long, b long")


def _across(own: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets on one list and of different components, with the number of lists in parts.

    A list of more than CHUNK sets is split by set, and each pair of its chunks is a
    group, so a group has at most about 2 x CHUNK sets.
    """
    own = own.drop("weight")
    lists = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = own.join(lists.select("gram", chunks.alias("chunks")), "gram").withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    placed = placed.select("gram", "chunk", other, "set_id", "size", "skip", "component")
    placed = placed.select("gram", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).alias("second"), "set_id", "size", "skip", "component")
    fields = ("set_id", "size", "skip", "component", "second", "i", "j", "gram")

    def groups(t):
        """All pairs within the groups of t, each pair once with its number of groups."""
        edge = np.flatnonzero(np.r_[True, (t["gram"][1:] != t["gram"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])])
        count = np.diff(np.r_[edge, len(t["gram"])])
        end = np.repeat(edge + count, count)
        at = np.arange(len(end))
        step = max(1, 500_000 // max(1, int(count.max())))
        for s in range(0, len(at), step):
            left, right = np.repeat(at[s : s + step], end[s : s + step] - at[s : s + step] - 1), slices(at[s : s + step] + 1, end[s : s + step])
            low, high = np.minimum(t["size"][left], t["size"][right]), np.maximum(t["size"][left], t["size"][right])
            ok = (t["component"][left] != t["component"][right]) & (low >= threshold * high - 1e-9)
            ok &= (t["i"][left] == t["j"][left]) | (t["second"][left] != t["second"][right])
            yield left[ok], right[ok]

    def run(batches):
        rest = None

        def emit(t):
            found = [np.concatenate(x) for x in zip(*groups(t))] if len(t["gram"]) else []
            if not found or not len(found[0]):
                return
            left, right = found
            swap = t["set_id"][left] > t["set_id"][right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            order = np.lexsort((t["set_id"][right], t["set_id"][left]))
            left, right = left[order], right[order]
            a, b = t["set_id"][left], t["set_id"][right]
            edge = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            met = np.diff(np.r_[edge, len(a)])
            left, right = left[edge], right[edge]
            yield pa.RecordBatch.from_arrays([pa.array(t["set_id"][left]), pa.array(t["set_id"][right]), *(pa.array(t[c][s], pa.int32()) for c in ("size", "skip") for s in (left, right)), pa.array(met, pa.int64())], ["a", "b", "size_a", "size_b", "skip_a", "skip_b", "met"])

        for b in batches:
            if not b.num_rows:
                continue
            t = {k: b.column(k).to_numpy(zero_copy_only=False) for k in fields}
            if rest is not None:
                t = {k: np.concatenate([rest[k], t[k]]) for k in fields}
            same = (t["gram"] == t["gram"][-1]) & (t["i"] == t["i"][-1]) & (t["j"] == t["j"][-1])
            cutoff = int(np.argmax(same))
            rest = {k: v[cutoff:] for k, v in t.items()}
            yield from emit({k: v[:cutoff] for k, v in t.items()})
        if rest is not None:
            yield from emit(rest)

    return placed.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(run, "a long, b long, size_a int, size_b int, skip_a int, skip_b int, met long")


def linked_sets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the sets that candidate pairs connect; docs is sketches(df), written."""
    sets = _searched(docs, threshold)
    known = _known_lists(sets)
    entries = _merged_lists(sets.withColumn("component", F.col("set_id")), known, threshold).drop("component")
    top = entries.groupBy("gram").agg(F.max(F.struct("weight", "set_id", "size", "skip")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", "b")
    sides = [F.col("set_id").alias("a"), F.col("b.set_id").alias("b"), F.col("size").alias("size_a"), F.col("b.size").alias("size_b"), F.col("skip").alias("skip_a"), F.col("b.skip").alias("skip_b"), F.lit(1).cast("long").alias("met")]
    star = entries.join(top, "gram").filter("set_id <> b.set_id").select(*sides)  # of two sets the heavier is always b
    connected = components(_meeting(star, threshold))
    placed = sets.join(connected.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    across = _meeting(_across(_merged_lists(placed, known, threshold), threshold), threshold)
    return components(connected.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across))


def divide_skip(values: np.ndarray, first: np.ndarray, threshold: float, side: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set, as a query, the earlier sets with a Jaccard coefficient of at least threshold.

    values[first[i]:first[i+1]] is set i, sorted; with side, only partners on another side
    count.  Gives arrays (query, partner, overlap).
    """
    sets = len(first) - 1
    size = np.diff(first)
    owner = np.repeat(np.arange(sets), size)
    order = np.argsort(values, kind="stable")
    sv, so = values[order], owner[order]
    begin = np.flatnonzero(np.r_[True, sv[1:] != sv[:-1]]) if len(sv) else np.zeros(0, np.int64)
    length = np.diff(np.r_[begin, len(sv)])
    code = np.empty(len(values), np.int64)
    code[order] = np.repeat(np.arange(len(begin)), length)
    posting = np.repeat(np.arange(len(begin)), length) * sets + so  # sorted: lists one after the other, each by set
    out = []
    for q in range(sets):
        own = code[first[q] : first[q + 1]]
        own = own[length[own] > 1]
        t = int(np.ceil(threshold * size[q] - 1e-9))  # the least overlap with any partner
        if t < 1 or len(own) < t:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        cum = np.cumsum(length[own])
        skip = _long_lists(cum, length[own], t)
        short, long = own[: len(own) - skip], own[len(own) - skip :]
        found, count = np.unique(so[slices(begin[short], begin[short] + length[short])], return_counts=True)
        ok = (found < q) & (count >= t - skip) & (size[found] >= threshold * size[q] - 1e-9) & (size[q] >= threshold * size[found] - 1e-9)
        if side is not None:
            ok &= side[found] != side[q]
        found, count = found[ok], count[ok]
        if len(found) and skip:
            probe = (long[None, :] * sets + found[:, None]).ravel()
            at = np.minimum(np.searchsorted(posting, probe), len(posting) - 1)
            count = count + (posting[at] == probe).reshape(len(found), skip).sum(1)
        ok = count >= threshold / (1 + threshold) * (size[q] + size[found]) - 1e-9
        if ok.any():
            out.append((np.full(int(ok.sum()), q), found[ok], count[ok]))
    return out


def _long_lists(cum: np.ndarray, length: np.ndarray, t: int) -> int:
    """How many of the longest lists to probe instead of merge, by the cost of both; t - 1 at most."""
    n, best, least = len(length), 0, None
    for skip in (0, t // 2, t - 1):
        if skip >= n:
            continue
        merge = cum[n - skip - 1]
        cost = merge * 4.0 + skip * min(merge / max(1, t - skip), length[n - skip - 1] * 2) * np.log2(2 + cum[-1])
        if least is None or cost < least:
            best, least = skip, cost
    return best


def _blocks(df: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """block, i, j, second, node, doc_id, copies and grams of every set that has candidates.

    Components of up to CHUNK_GRAMS n-grams lie in one block with others, i and j null;
    larger ones are split by set, and each pair of chunks i and j is a block, in which
    second tells the sets of j.  docs is sketches(df), written.
    """
    spark = df.sparkSession
    linked = linked_sets(docs, threshold).withColumnRenamed("node", "set_id")
    chosen = cut(_sets(docs).join(linked, "set_id").withColumnRenamed("set_id", "node"))
    weight = chosen.groupBy("component").agg(F.ceil(F.sum("size") / CHUNK_GRAMS).cast("int").alias("chunks"))
    needed = IdFilter(chosen)

    def full(batches):
        for b in slice_batches(batches):
            values, first = doc_sets(words(b.column("text")), n, BITS)
            sid = fold(values, first).view(np.int64)
            keep = (np.diff(first) > 0) & needed.maybe(b.column("doc_id").to_numpy())
            at = np.flatnonzero(keep)
            blob = _blobs(values[slices(first[at], first[at + 1])], first[at + 1] - first[at])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(sid[at]), blob], ["doc_id", "node", "grams"])

    blobs = docs_only(df).filter("doc_id is not null").mapInArrow(full, "doc_id long, node long, grams binary")
    own = blobs.join(chosen.join(weight, "component"), ["node", "doc_id"])
    small, large = own.filter("chunks = 1"), own.filter("chunks > 1")
    common = ("node", "doc_id", "copies", "grams")
    whole = small.select(F.pmod(F.xxhash64("component"), F.lit(4 * parts(spark))).alias("block"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(False).alias("second"), *common)
    split = large.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    split = split.select("component", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"), *common)
    split = split.select(F.col("component").alias("block"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).alias("second"), *common)
    return whole.unionByName(split)


def _sets(docs: DataFrame) -> DataFrame:
    """set_id, its least doc_id, size and number of documents."""
    return docs.select("set_id", "doc_id", "size").distinct().groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def _search(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block's sets, by size, their sizes, and the pairs found among them as places in these, with their overlap."""
    _, at = np.unique(t.column("node").to_numpy(), return_index=True)
    column = t.column("grams").combine_chunks()
    grams = [_unpacked(np.frombuffer(column[int(i)].as_buffer(), np.uint8)) for i in at]
    order = np.argsort([len(g) for g in grams], kind="stable")
    size = np.array([len(grams[i]) for i in order])
    rows = at[order]
    side = t.column("second").to_numpy()[rows] if t.column("i")[0].as_py() != t.column("j")[0].as_py() else None
    found = divide_skip(np.concatenate([grams[i] for i in order]), np.r_[0, np.cumsum(size)].astype(np.int64), threshold, side)
    pairs = np.column_stack([np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)])
    return rows, size, pairs


def _groups(df: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """set_id, component and links, the number of documents with other sets that it joins, of the sets that join others; docs is sketches(df), written."""

    def search(t):
        rows, _, pairs = _search(t, threshold)
        q, r, _ = pairs.T
        copies = t.column("copies").to_numpy()[rows]
        links = np.bincount(q, copies[r], len(rows)) + np.bincount(r, copies[q], len(rows))
        label = np.arange(len(rows))
        while len(q):
            low = np.minimum(label[q], label[r])
            before = label.copy()
            np.minimum.at(label, q, low)
            np.minimum.at(label, r, low)
            label = label[label]
            if np.array_equal(before, label):
                break
        joined = np.unique(pairs[:, :2])
        node = t.column("node").to_numpy()[rows]
        whole = t.column("i")[0].as_py() is None
        return pa.table({"set_id": pa.array(node[joined]), "component": pa.array(node[label[joined]]), "links": pa.array(links[joined].astype(np.int64)), "whole": pa.array(np.full(len(joined), whole))})

    found = cut(_blocks(df, docs, n, threshold).groupBy("block", "i", "j").applyInArrow(search, "set_id long, component long, links long, whole boolean"))
    split = found.filter("not whole")
    joined = components(split.select(F.col("set_id").alias("a"), F.col("component").alias("b")))
    split = split.groupBy("set_id").agg(F.sum("links").alias("links")).join(joined.withColumnRenamed("node", "set_id"), "set_id")
    return found.filter("whole").select("set_id", "component", "links").unionByName(split.select("set_id", "component", "links"))


def _documents(df: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """doc_id, class_id and links of every document that joins another; docs is sketches(df), written."""
    sets = _sets(docs).join(_groups(df, docs, n, threshold), "set_id", "left")
    sets = sets.select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).filter("links > 0")
    least = sets.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return docs.select("set_id", "doc_id").distinct().join(sets.drop("doc_id").join(least, "component"), "set_id").select("doc_id", "class_id", "links")


def join(df: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and links of every document that joins another."""
    return _documents(df, cut(sketches(df, n)), n, threshold)


def pairs(df: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs of different sets that join, each set by its least doc_id, with overlap and Jaccard coefficient.

    They are as many as a group of near copies has pairs of texts, so join() only
    counts them; with the documents of each set they give every link.
    """

    def search(t):
        rows, size, found = _search(t, threshold)
        q, r, c = found.T
        doc = t.column("doc_id").to_numpy()[rows]
        return pa.table({"doc_a": pa.array(np.minimum(doc[q], doc[r])), "doc_b": pa.array(np.maximum(doc[q], doc[r])), "overlap": pa.array(c, pa.int32()), "jaccard": pa.array(c / np.maximum(size[q] + size[r] - c, 1))})

    return _blocks(df, cut(sketches(df, n)), n, threshold).groupBy("block", "i", "j").applyInArrow(search, "doc_a long, doc_b long, overlap int, jaccard double")


def keep_one(df: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """df without the documents that join, directly or through others, one with a smaller doc_id."""
    docs = cut(sketches(df, n))
    gone_id, turn = fresh(df, "gone"), fresh(df, "turn")
    gone = _documents(df, docs, n, threshold).filter("doc_id > class_id").select(F.col("doc_id").alias(gone_id)).distinct()
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        by = Window.partitionBy("doc_id").orderBy("text")
        df = df.withColumn(turn, F.row_number().over(by)).filter(F.col("doc_id").isNull() | (F.col(turn) == 1)).drop(turn)
    return df.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have near duplicates, with their class and number of links."""
    return join(table(spark, sf_dir, "documents"))
