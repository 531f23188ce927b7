"""Coupling and instability metrics of files and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_abstract, zone
from ..functions.paths import ancestors
from .graph import CodeGraph


def _with_metrics(df: DataFrame, abstractness: Column) -> DataFrame:
    """Adds i, a, d and zone to a table of ca and ce."""
    i = F.when(F.col("ca") + F.col("ce") == 0, 0.5).otherwise(F.col("ce") / (F.col("ca") + F.col("ce")))
    df = df.withColumns({"i": i, "a": abstractness})
    return df.withColumns({"d": F.abs(F.col("a") + F.col("i") - 1), "zone": zone(F.col("i"), F.col("a"))})


def definition_counts(chunks: DataFrame) -> DataFrame:
    """path, abstract_count, concrete_count of chunks(path, type[, flags])."""
    flags = F.col("flags") if "flags" in chunks.columns else None
    abstract = is_abstract(F.col("type"), flags)
    return chunks.groupBy("path").agg(F.count_if(abstract).alias("abstract_count"), F.count_if(~abstract).alias("concrete_count"))


def coupling(graph: CodeGraph, definitions: DataFrame | None = None) -> DataFrame:
    """id, ca, ce, i, a, d, zone of every node; definitions(path, abstract_count, concrete_count)."""
    df = graph.degrees().select("id", F.col("in_degree").alias("ca"), F.col("out_degree").alias("ce"))
    if definitions is None:
        return _with_metrics(df, F.lit(0.0))
    df = df.join(definitions.withColumnRenamed("path", "id"), "id", "left").fillna(0, ["abstract_count", "concrete_count"])
    total = F.col("abstract_count") + F.col("concrete_count")
    return _with_metrics(df, F.when(total > 0, F.col("abstract_count") / total).otherwise(0.0))


def directory_coupling(graph: CodeGraph, definitions: DataFrame | None = None) -> DataFrame:
    """directory, ca, ce, i, a, d, zone of all directories at once.

    ca counts the distinct outer files that depend on files below, ce the distinct
    outer files those depend on.
    """
    under = lambda c: F.explode(F.filter(ancestors(F.col(c)), lambda x: x != ""))
    outside = lambda c: ~F.col(c).startswith(F.concat(F.col("directory"), F.lit("/")))
    ce = graph.edges.select("dst", under("src").alias("directory")).filter(outside("dst")).groupBy("directory").agg(F.countDistinct("dst").alias("ce"))
    ca = graph.edges.select("src", under("dst").alias("directory")).filter(outside("src")).groupBy("directory").agg(F.countDistinct("src").alias("ca"))
    dirs = graph.nodes.select(under("id").alias("directory")).distinct()
    df = dirs.join(ca, "directory", "left").join(ce, "directory", "left").fillna(0, ["ca", "ce"])
    if definitions is None:
        return _with_metrics(df, F.lit(0.0))
    d = definitions.select(under("path").alias("directory"), "abstract_count", "concrete_count").groupBy("directory").agg(F.sum("abstract_count").alias("x"), F.sum("concrete_count").alias("y"))
    df = df.join(d, "directory", "left").fillna(0, ["x", "y"])
    return _with_metrics(df, F.when(F.col("x") + F.col("y") > 0, F.col("x") / (F.col("x") + F.col("y"))).otherwise(0.0)).drop("x", "y")


def zone_report(metrics: DataFrame) -> DataFrame:
    """zone, files (sorted)."""
    return metrics.groupBy("zone").agg(F.sort_array(F.collect_list("id")).alias("files"))


def zone_counts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("zone").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("d"), 6).alias("avg_distance"))


def coupling_summary(metrics: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return metrics.agg(F.count(F.lit(1)).alias("files"), mean("i").alias("avg_instability"), mean("a").alias("avg_abstractness"), mean("d").alias("avg_distance"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("zone") == "main"), F.count(F.lit(1))), F.lit(0.0)), 6).alias("health_score"))


def worst(metrics: DataFrame, k: int = 20) -> DataFrame:
    """The k modules that are farthest from the main sequence."""
    return metrics.orderBy(F.desc("d"), "id").limit(k)


def critical_modules(metrics: DataFrame, ca_threshold: int = 5, d_threshold: float = 0.4) -> DataFrame:
    """id, score, reasons of modules that are risky to change, the riskiest first."""
    ca, i = F.col("ca"), F.col("i")
    rules = [
        (ca >= ca_threshold, 2.0 * ca, F.concat(F.lit("High impact ("), ca.cast("string"), F.lit(" dependents)"))),
        ((F.col("zone") == "pain") & (F.col("d") > d_threshold), F.lit(20.0), F.lit("Stable but concrete (hard to extend)")),
        (F.col("zone") == "uselessness", F.lit(15.0), F.lit("Unstable and abstract (possibly unused)")),
        ((i > 0.7) & (ca > 0), F.lit(10.0), F.concat(F.lit("Unstable with "), ca.cast("string"), F.lit(" dependents"))),
    ]
    score = sum((F.when(c, x).otherwise(0.0) for c, x, _ in rules), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, _, r in rules]))
    return metrics.select("id", score.alias("score"), reasons.alias("reasons")).filter("score > 0").orderBy(F.desc("score"), "id")
