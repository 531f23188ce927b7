"""Manifests: the tables of an analysed tree, as parquet and as one JSON document."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import ownership

VERSION = "1.3.0"
_CHUNK = "id string, type string, name string, signature string, start_line int, end_line int, parent string, exported boolean, docstring string, semantic_anchor string"
_IMPORT = "module string, symbols array<string>, alias string, is_relative boolean, line int"
_EXPORT = "name string, type string, line int, is_default boolean"
_nested = lambda fields: ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))
_DOCUMENT = (
    f"meta struct<version: string, root: string, generated_at: string>, files array<struct<path: string, language: string, size_bytes: bigint, hash: string, "
    f"chunks: array<struct<{_nested(_CHUNK)}>>, imports: array<struct<{_nested(_IMPORT)}>>, exports: array<struct<{_nested(_EXPORT)}>>>>, "
    "graph struct<nodes: array<string>, edges: array<array<string>>>, errors array<struct<path: string, error_type: string, message: string, line: int>>"
)
TABLES = ("files", "chunks", "imports", "exports", "edges", "errors")


def write_tables(tables: dict[str, DataFrame], at: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}")


def read_tables(spark: SparkSession, at: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{at}/{name}") for name in TABLES if os.path.exists(f"{at}/{name}") or "://" in at}


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of JSON manifests (one file or many); missing fields get their defaults."""
    df = spark.read.json(path, schema=_DOCUMENT, multiLine=True)
    f = df.select(F.explode("files").alias("f"))
    each = lambda c: f.select("f.path", F.explode(f"f.{c}").alias("x")).select("path", "x.*")
    none = F.array().cast("array<string>")
    return {
        "files": f.select("f.path", F.coalesce("f.language", F.lit("")).alias("language"), F.coalesce("f.size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("f.hash", F.lit("")).alias("hash")),
        "chunks": each("chunks").fillna({"exported": False}),
        "imports": each("imports").fillna({"is_relative": False, "line": 0}).withColumn("symbols", F.coalesce("symbols", none)),
        "exports": each("exports").fillna({"is_default": False, "line": 0}),
        "edges": df.select(F.explode("graph.edges").alias("e")).select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst")),
        "errors": df.select(F.explode("errors").alias("x")).select("x.*"),
        "meta": df.select("meta.*"),
    }


def nested(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a file with its chunks, imports and exports as arrays."""
    out = tables["files"].select("path", "language", "size_bytes", "hash")
    for name, order in (("chunks", "start_line"), ("imports", "line"), ("exports", "line")):
        rows = tables[name]
        rest = [c for c in rows.columns if c not in ("path", order)]
        packed = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))
        out = out.join(packed, "path", "left")
    return out


def write_json(tables: dict[str, DataFrame], path: str, root: str = ".") -> None:
    """One indented document, for trees that a reader of JSON can hold; files are streamed through the driver in path order."""
    files = (json.loads(r[0]) for r in nested(tables).orderBy("path").select(F.to_json(F.struct("*"))).toLocalIterator())
    edges = sorted([r.src, r.dst] for r in tables["edges"].collect()) if "edges" in tables else []
    out = {"meta": {"version": VERSION, "root": root}, "files": [{"chunks": [], "imports": [], "exports": []} | f for f in files], "graph": {"nodes": sorted({x for e in edges for x in e}), "edges": edges}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, ensure_ascii=False)


def project_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """files, size_bytes, languages, chunks, imports, exports, edges of an analysed tree."""
    f = tables["files"].agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.countDistinct(F.when(F.col("language") != "", F.col("language"))).alias("languages"))
    for name in ("chunks", "imports", "exports", "edges"):
        f = f.crossJoin(tables[name].agg(F.count(F.lit(1)).alias(name)))  # one row each
    return f


SERIALIZED_KINDS = ("serialized_guid", "unity_component", "scriptable_object_type", "prefab_instance", "animator_motion", "unity_event")


def project_metrics(files: DataFrame, chunks: DataFrame, edges: DataFrame, evidence: DataFrame, calls: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row of thirteen counters of an analysed tree.

    files(path, language), chunks(path, exported), edges(src, dst), evidence(kinds,
    engine), calls(kind), cycles(component, id).  Dependencies and cycles are the
    project's own where all their ends are.
    """
    n, own = F.count(F.lit(1)), lambda c: ownership(F.col(c)).isin("project-owned", "repository")
    parts = [
        files.agg(n.alias("files"), F.count_if(F.coalesce("language", F.lit("")) != "").alias("source_files")),
        chunks.agg(n.alias("symbols"), F.count_if("exported").alias("public_symbols")),
        edges.agg(n.alias("dependencies"), F.count_if(own("src") & own("dst")).alias("project_owned_dependencies")),
        evidence.agg(F.count_if(F.col("engine").isin("roslyn", "mixed")).alias("semantic_csharp_dependencies"), F.count_if(F.arrays_overlap("kinds", F.array(*map(F.lit, SERIALIZED_KINDS)))).alias("serialized_dependencies")),
        calls.agg(F.count_if(F.col("kind") != "unity_event").alias("roslyn_call_sites"), F.count_if(F.col("kind") == "unity_event").alias("unity_event_calls"), n.alias("call_sites")),
        cycles.groupBy("component").agg(F.bool_and(own("id")).alias("own")).agg(n.alias("cycles"), F.count_if("own").alias("project_owned_cycles")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def error_counts(errors: DataFrame) -> DataFrame:
    """error_type, errors."""
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))
