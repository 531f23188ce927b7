"""Directory trees and inventory summaries over files(path, size_bytes[, language])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, depth, dirname, extension


def directories(files: DataFrame, most_depth: int | None = 2) -> DataFrame:
    """directory, file_count, extensions (a map of counts) of every directory to a depth, '' being the root.

    A directory of directories only has no files of its own and is listed with 0.
    """
    up = files.select(F.explode(ancestors(F.col("path"))).alias("directory")).distinct()
    if most_depth is not None:
        up = up.filter(depth(F.col("directory")) <= most_depth)
    own = files.groupBy(dirname(F.col("path")).alias("directory"), extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    own = own.groupBy("directory").agg(F.sum("n").alias("file_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("ext", "n")))).alias("extensions"))
    return up.join(own, "directory", "left").select("directory", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("extensions", F.create_map().cast("map<string,bigint>")).alias("extensions"))


def rollup(files: DataFrame) -> DataFrame:
    """directory, total_files, direct_files, subdirectories, size_bytes: totals over all that lies below."""
    each = files.select("size_bytes", dirname(F.col("path")).alias("own"), F.explode(ancestors(F.col("path"))).alias("directory"))
    totals = each.groupBy("directory").agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("own") == F.col("directory")).alias("direct_files"), F.sum("size_bytes").alias("size_bytes"))
    children = totals.filter("directory <> ''").groupBy(dirname(F.col("directory")).alias("directory")).agg(F.count(F.lit(1)).alias("subdirectories"))
    return totals.join(children, "directory", "left").fillna(0, ["subdirectories"]).select("directory", "total_files", "direct_files", "subdirectories", "size_bytes")


def language_rollup(files: DataFrame) -> DataFrame:
    """directory, language, files: the languages of all that lies below a directory."""
    return files.filter("language is not null").select("language", F.explode(ancestors(F.col("path"))).alias("directory")).groupBy("directory", "language").agg(F.count(F.lit(1)).alias("files"))


def inventory(files: DataFrame) -> DataFrame:
    """extension, files, size_bytes; files without one are under '(no ext)'."""
    ext = extension(F.col("path"))
    return files.groupBy(F.when(ext == "", "(no ext)").otherwise(ext).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


def similar_paths(files: DataFrame, text: str, k: int = 5) -> DataFrame:
    """Paths that hold the text or end in its last part, as a hint where a path is unknown."""
    p = F.col("path")
    return files.filter(p.contains(text) | p.endswith(text.rsplit("/", 1)[-1])).select("path").orderBy("path").limit(k)


def render(files: DataFrame, most_depth: int = -1, with_files: bool = True, name: str = ".") -> str:
    """The tree as text, directories before files; for trees that a reader can take in."""
    rows = files.select(dirname(F.col("path")).alias("d"), basename(F.col("path")).alias("f")).collect()
    root: dict = {}
    for r in rows:
        at = root
        for part in r.d.split("/") if r.d else []:
            at = at.setdefault(part + "/", {})
        at[r.f] = None
    out = [f"{name}/"]

    def walk(at: dict, prefix: str, level: int) -> None:
        if 0 <= most_depth <= level:
            return
        items = sorted((k for k in at if with_files or at[k] is not None), key=lambda k: (at[k] is None, k))
        for k in items:
            end = k is items[-1]
            out.append(prefix + ("└── " if end else "├── ") + k)
            if at[k] is not None:
                walk(at[k], prefix + ("    " if end else "│   "), level + 1)

    walk(root, "", 0)
    return "\n".join(out)
