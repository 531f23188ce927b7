"""Merging of edge evidence from several engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIDENCE = ("partial", "resolved", "structured", "exact")


def merge(records: DataFrame) -> DataFrame:
    """source, target, kinds, symbols, lines, confidence, engine and evidence of every pair.

    records(source, target, kind, symbol, line, confidence, engine).  Sets are sorted,
    the highest confidence stays, two engines or more are 'mixed'; pairs whose target
    is a .meta file go.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("confidence"))
    some = lambda c: F.sort_array(F.collect_set(c))
    g = records.filter(~F.col("target").endswith(".meta")).groupBy("source", "target").agg(
        some("kind").alias("kinds"), some("symbol").alias("symbols"), some("line").alias("lines"), F.max(rank).alias("rank"), some("engine").alias("engines"),
        F.sort_array(F.collect_set(F.struct("kind", "symbol", "line", "engine"))).alias("evidence"),
    )
    confidence = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.greatest(F.col("rank"), F.lit(1)).cast("int"))
    return g.select("source", "target", "kinds", "symbols", "lines", confidence.alias("confidence"), F.when(F.size("engines") > 1, "mixed").otherwise(F.element_at("engines", 1)).alias("engine"), "evidence")
