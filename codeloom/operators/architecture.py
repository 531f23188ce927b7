"""Architecture layers: classification, second pass over imports, violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import LAYERS, layer_from_path, layer_index
from ..lineage import cut
from .graph import CodeGraph

TYPE_EXPORTS = ("type", "interface", "type_alias")


def export_layers(exports: DataFrame) -> DataFrame:
    """path, layer: 'shared' where types are more than twice the other exports."""
    t = F.count_if(F.col("type").isin(*TYPE_EXPORTS))
    n = F.count(F.lit(1))
    return exports.groupBy("path").agg((t > 2 * (n - t)).alias("types")).filter("types").select("path", F.lit("shared").alias("layer"))


def classify(graph: CodeGraph, exports: DataFrame | None = None) -> DataFrame:
    """id, layer, method, confidence of every node.

    By path first, then by exports.  The rest are taken in the order of their ids:
    one layer above the highest of the dependencies known by then, 'shared' without
    dependencies, 'domain' where none is known.  A node waits for those of its
    dependencies that come before it, so each round settles all that wait for none.
    """
    known = graph.nodes.select("id", layer_from_path(F.col("id")).alias("by_path"))
    if exports is not None:
        known = known.join(export_layers(exports).select(F.col("path").alias("id"), F.col("layer").alias("by_exports")), "id", "left")
    else:
        known = known.withColumn("by_exports", F.lit(None).cast("string"))
    first = cut(known.select("id", F.coalesce("by_path", "by_exports").alias("layer"), F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_exports").isNotNull(), "exports").alias("method")))
    settled = first.filter("layer is not null").select("id", layer_index(F.col("layer")).cast("int").alias("k"))
    waiting = cut(first.filter("layer is null").select("id"))
    edges = cut(graph.edges.join(waiting.withColumnRenamed("id", "src"), "src", "left_semi"))
    has = edges.select(F.col("src").alias("id")).distinct()
    none = waiting.join(has, "id", "left_anti").select("id", F.lit(LAYERS.index("shared")).alias("k"))
    settled, waiting = cut(settled.union(none)), cut(waiting.join(has, "id", "left_semi"))
    # dependencies that count: settled from the first pass, or nodes that come earlier
    early = edges.join(first.filter("layer is not null").select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").union(edges.filter("dst < src").select("src", "dst")).distinct()
    early = cut(early)
    while waiting.limit(1).count():  # the least id left is always ready
        blocked = early.join(waiting.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        ready = waiting.join(blocked, "id", "left_anti")
        best = early.join(settled.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("k").alias("best"))
        new = ready.join(best, "id", "left").select("id", F.when(F.col("best").isNull(), LAYERS.index("domain")).otherwise(F.least(F.col("best") + 1, F.lit(len(LAYERS) - 1))).alias("k"))
        new = cut(new)
        settled, waiting = cut(settled.union(new)), cut(waiting.join(new, "id", "left_anti"))
    names = F.array(*[F.lit(x) for x in LAYERS])
    out = settled.join(first.select("id", "method"), "id")
    method = F.coalesce("method", F.lit("imports"))
    return out.select("id", F.element_at(names, F.col("k") + 1).alias("layer"), method.alias("method"), F.when(method == "path", 0.9).when(method == "exports", 0.7).otherwise(0.5).alias("confidence"))


def violations(graph: CodeGraph, layers: DataFrame) -> DataFrame:
    """src, dst, src_layer, dst_layer of edges to a later layer than their own."""
    a, b = (layers.select(F.col("id").alias(e), F.col("layer").alias(f"{e}_layer")) for e in ("src", "dst"))
    return graph.edges.join(a, "src").join(b, "dst").filter(layer_index(F.col("dst_layer")) > layer_index(F.col("src_layer"))).select("src", "dst", "src_layer", "dst_layer")


def layer_counts(layers: DataFrame) -> DataFrame:
    """layer, files: all five layers, also those without files."""
    dim = layers.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    return dim.join(layers.groupBy("layer").agg(F.count(F.lit(1)).alias("files")), "layer", "left").fillna(0, ["files"])
