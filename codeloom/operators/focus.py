"""Ego-centric views of a graph, and files that connect its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import bridge_risk, hidden_risk, is_test_file, is_type_file
from ..lineage import cut
from .graph import CodeGraph, spread_small

#: Score of a file that the score table lacks.
UNKNOWN_SCORE = 0.001


def neighborhood(graph: CodeGraph, start: str, depth: int = 3) -> DataFrame:
    """id, distance, direction of all files within ``depth`` steps either way; nothing for an unknown start."""
    f = graph.distances(start, depth).withColumnRenamed("distance", "f")
    b = graph.distances(start, depth, forward=False).withColumnRenamed("distance", "b")
    j = f.join(b, "id", "full_outer")
    up, down = F.col("b"), F.col("f")
    direction = F.when(F.col("id") == start, "focal").when(up.isNull() | (down < up), "dependency").when(down.isNull() | (up < down), "dependent").otherwise("both")
    return j.select("id", F.least(down, up).alias("distance"), direction.alias("direction"))


def focus(graph: CodeGraph, scores: DataFrame, start: str, depth: int = 3, decay: float = 0.8, least: float = 1e-4) -> DataFrame:
    """id, distance, direction, centrality, score, is_test, is_type, best first.

    The score is the centrality times decay to the power of the distance; scores under
    ``least`` go.
    """
    near = cut(neighborhood(graph, start, depth))
    own = scores.select("id", F.col("score").alias("centrality")).join(spread_small(near.select("id")), "id", "left_semi")
    near = near.join(own, "id", "left").fillna(UNKNOWN_SCORE, ["centrality"])
    scored = near.withColumn("score", F.col("centrality") * F.pow(F.lit(decay), F.col("distance")))
    return scored.filter(F.col("score") >= least).select("*", is_test_file(F.col("id")).alias("is_test"), is_type_file(F.col("id")).alias("is_type")).orderBy(F.desc("score"), "id")


def focus_summary(graph: CodeGraph, found: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """neighborhood (before the score threshold), max_depth, direct_dependencies, direct_dependents, tests, types."""
    near = neighborhood(graph, start, depth).agg(F.count(F.lit(1)).alias("neighborhood"))
    d = F.col("distance") == 1
    return near.crossJoin(  # one row each
        found.agg(
            F.coalesce(F.max("distance"), F.lit(0)).alias("max_depth"), F.count_if(d & F.col("direction").isin("dependency", "both")).alias("direct_dependencies"),
            F.count_if(d & F.col("direction").isin("dependent", "both")).alias("direct_dependents"), F.count_if("is_test").alias("tests"), F.count_if("is_type").alias("types"),
        )
    )


def bridges(graph: CodeGraph, betweenness: DataFrame, scores: DataFrame, threshold: float = 0.05, k: int = 10) -> DataFrame:
    """id, betweenness, pagerank, risk, description of the k files that most shortest paths cross."""
    bc, pr, i, o = F.col("betweenness"), F.col("pagerank"), F.col("in_degree"), F.col("out_degree")
    df = betweenness.filter(bc >= threshold).join(scores.select("id", F.col("score").alias("pagerank")), "id", "left").fillna(0.0, ["pagerank"]).join(graph.degrees(), "id")
    path = F.lower("id")
    links = F.when((i > 0) & (o > 0), F.format_string("connects %d importers to %d dependencies", i, o)).when(i > 0, F.format_string("%d importers, no dependencies", i)).when(o > 0, F.format_string("imports %d files", o))
    text = F.concat_ws(
        " - ", links, F.when(bc > 2 * pr, "critical but under-recognized"), F.when(path.contains("index") | path.contains("__init__"), "barrel/re-export"),
        F.when(path.contains("adapter") | path.contains("bridge"), "explicit adapter pattern"), F.when(path.contains("client"), "client interface"),
    )
    return df.orderBy(F.desc("betweenness"), "id").limit(k).select("id", "betweenness", "pagerank", bridge_risk(bc).alias("risk"), F.when(text == "", "bridge file").otherwise(text).alias("description"))


def hidden_bridges(betweenness: DataFrame, scores: DataFrame, ratio: float = 2.0, least: float = 0.01) -> DataFrame:
    """id, betweenness, pagerank, ratio, risk of files that paths cross far more often than their score tells; a score of 0 tells nothing."""
    bc = F.col("betweenness")
    df = betweenness.filter(bc > least).join(scores.select("id", F.col("score").alias("pagerank")), "id", "left").fillna(UNKNOWN_SCORE, ["pagerank"])
    df = df.withColumn("ratio", bc / F.nullif("pagerank", F.lit(0.0))).filter(F.col("ratio") > ratio)
    return df.select("id", "betweenness", "pagerank", "ratio", hidden_risk(bc).alias("risk")).orderBy(F.desc(bc / F.greatest("pagerank", F.lit(UNKNOWN_SCORE))), "id")


def dependencies_of(graph: CodeGraph, path: str, evidence: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """relation, id, symbols, line of what a file depends on and what depends on it.

    evidence(source, target, symbols, lines) tells symbols and the first line;
    imports(path, module, symbols, line, is_external) adds the external ones.
    """
    out = graph.edges.filter(F.col("src") == path).select(F.lit("dependency").alias("relation"), F.col("dst").alias("id"), "src", "dst")
    into = graph.edges.filter(F.col("dst") == path).select(F.lit("dependent").alias("relation"), F.col("src").alias("id"), "src", "dst")
    both = out.unionByName(into)
    if evidence is None:
        found = both.select("relation", "id", F.array().cast("array<string>").alias("symbols"), F.lit(None).cast("int").alias("line"))
    else:
        e = evidence.filter((F.col("source") == path) | (F.col("target") == path)).select(F.col("source").alias("src"), F.col("target").alias("dst"), "symbols", F.array_min("lines").cast("int").alias("line"))
        found = both.join(e, ["src", "dst"], "left").select("relation", "id", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), "line")
    if imports is not None:
        found = found.unionByName(imports.filter((F.col("path") == path) & F.col("is_external")).select(F.lit("external").alias("relation"), F.col("module").alias("id"), "symbols", F.col("line").cast("int").alias("line")))
    return found.orderBy("relation", "id")
