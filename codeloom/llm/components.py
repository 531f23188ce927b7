"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges(a, b); the component is its least node.

    Alternating large and small stars (Kiveris et al., 2014): a round first hangs the
    larger neighbours of every node on the least one, then the smaller ones, until
    every component is one star.  Rounds grow with the logarithm of the graph; their
    edges, never more than at first, are written to the shared checkpoint folder.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        large = _with_least(e.unionByName(e.select(v.alias("u"), u.alias("v")))).withColumn("m", F.least(m, u)).filter(v > u).select(v.alias("u"), m.alias("v")).distinct()
        down = _with_least(large)
        e = cut(down.select("u", m.alias("v")).unionByName(down.filter(v > m).select(v.alias("u"), m.alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return e.select(u.alias("node"), v.alias("component")).unionByName(e.select(v.alias("node"), v.alias("component")).distinct())
        before = now


def _with_least(e: DataFrame) -> DataFrame:
    """e with the least v of each u: an aggregation that combines before the shuffle, and a join whose skew can be split."""
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
