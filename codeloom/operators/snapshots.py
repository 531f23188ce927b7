"""Snapshots of files: diff, staleness, cache, moves of anchors, validation."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state (added, removed, modified, unchanged) of two tables (path, hash)."""
    j = old.select("path", F.col("hash").alias("h0")).join(new.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    state = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") == F.col("h1"), "unchanged").otherwise("modified")
    return j.select("path", state.alias("state"))


def source_hash(files: DataFrame) -> DataFrame:
    """One hash over all paths and hashes in path order; zeros for no files.

    A hash is sequential, so the rows pass one task, sorted with spilling, as a stream.
    """

    def run(batches):
        found, any_ = hashlib.sha256(), False
        for b in batches:
            if b.num_rows:
                joined = "|".join(pc.binary_join_element_wise(b.column("path"), b.column("hash"), ":").to_pylist())
                found.update((("|" if any_ else "") + joined).encode())
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([found.hexdigest()[:16]])], ["source_hash"])

    rows = files.select(F.col("path").cast("string").alias("path"), F.col("hash").cast("string").alias("hash")).filter("path is not null and hash is not null")
    return rows.repartition(1).sortWithinPartitions("path", "hash").mapInArrow(run, "source_hash string").agg(F.coalesce(F.max("source_hash"), F.lit("0" * 16)).alias("source_hash"))


def staleness(known: DataFrame | None, current: DataFrame) -> DataFrame:
    """is_stale and the numbers of changed, added and removed files; without a known snapshot all are added."""
    if known is None:
        known = current.limit(0)
    d = diff(known, current)
    n = lambda s: F.count_if(F.col("state") == s)
    return d.agg((F.count_if(F.col("state") != "unchanged") > 0).alias("is_stale"), n("modified").alias("changed"), n("added").alias("added"), n("removed").alias("removed"))


def split_by_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of files(path, hash, ...) against cache(path, hash, ...)."""
    key = cache.select("path", "hash").distinct()
    return files.join(key, ["path", "hash"], "left_semi"), files.join(key, ["path", "hash"], "left_anti")


def prune_cache(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("path").distinct(), "path", "left_semi")


def invalidate(cache: DataFrame, pattern: str) -> DataFrame:
    """The cache without the paths that a SQL LIKE pattern matches."""
    return cache.filter(~F.col("path").like(pattern))


def hit_rate(files: DataFrame, cache: DataFrame) -> DataFrame:
    """hits, misses and the rate in percent, 100 for no files."""
    hit = files.join(cache.select("path", "hash", F.lit(True).alias("hit")).distinct(), ["path", "hash"], "left")
    hits, n = F.count_if(F.col("hit")), F.count(F.lit(1))
    return hit.agg(hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.try_divide(100.0 * hits, n), F.lit(100.0)).alias("hit_rate"))


def anchor_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """anchor, old_location, new_location of chunks(anchor, location) that are elsewhere now.

    An anchor on several places is taken by its first.
    """
    a = old.groupBy("anchor").agg(F.min("location").alias("old_location"))
    b = new.groupBy("anchor").agg(F.min("location").alias("new_location"))
    return a.join(b, "anchor").filter("old_location <> new_location")


def duplicate_anchors(chunks: DataFrame) -> DataFrame:
    """anchor, copies, first_location of anchors on more than one place."""
    return chunks.groupBy("anchor").agg(F.count(F.lit(1)).alias("copies"), F.min("location").alias("first_location")).filter("copies > 1")


def validate(files: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, subject: missing and repeated paths, repeated chunk ids, wrong line ranges, dangling edge ends."""
    name = lambda df, problem, c: df.select(F.lit(problem).alias("problem"), F.col(c).cast("string").alias("subject"))
    repeated = lambda df, c: df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    checks = [
        name(files.filter("path is null or path = ''"), "missing path", "path"), name(repeated(files, "path"), "repeated path", "path"), name(repeated(chunks, "id"), "repeated chunk", "id"),
        name(chunks.filter("start_line < 1 or end_line < start_line"), "wrong lines", "id"), name(ends.join(files, "path", "left_anti"), "dangling edge", "path"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
