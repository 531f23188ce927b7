"""What an analysis was made from: stored hashes, footers of written files, moves of anchors."""

from __future__ import annotations

import datetime
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshots

FILE_NAME = "staleness.json"
_HASH_LINE = re.compile(r"\*Source hash: ([0-9a-f]{16})\*")


def now() -> str:
    """The time in ISO 8601, UTC."""
    return datetime.datetime.now(datetime.UTC).isoformat()


def hashed(files: DataFrame) -> DataFrame:
    """path, hash of the sources, without the maps that this engine writes itself."""
    return files.select("path", "hash").filter(~F.col("path").endswith("AGENTS.md"))


def save(files: DataFrame, folder: str, generated_at: str | None = None) -> str:
    """Writes the hashes of files(path, hash) with their common hash as one JSON file; paths are streamed in order."""
    os.makedirs(folder, exist_ok=True)
    at = os.path.join(folder, FILE_NAME)
    own = hashed(files)
    common = snapshots.source_hash(own).first()[0]
    n = 0
    with open(at + ".part", "w", encoding="utf-8") as f:
        f.write('{"source_hash": ' + json.dumps(common) + ', "generated_at": ' + json.dumps(generated_at or now()) + ', "file_hashes": {')
        for r in own.orderBy("path").toLocalIterator():
            f.write((",\n " if n else "\n ") + json.dumps(r.path) + ": " + json.dumps(r.hash))
            n += 1
        f.write(f'\n}}, "file_count": {n}}}\n')
    os.replace(at + ".part", at)
    return at


def load(spark: SparkSession, folder: str) -> tuple[dict, DataFrame] | None:
    """({source_hash, generated_at, file_count}, path and hash of files), or None where nothing or nothing whole is stored."""
    try:
        with open(os.path.join(folder, FILE_NAME), encoding="utf-8") as f:
            found = json.load(f)
        head = {k: found[k] for k in ("source_hash", "generated_at", "file_count")}
        rows = [(str(p), str(h)) for p, h in found["file_hashes"].items()]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return None
    return head, spark.createDataFrame(rows, "path string, hash string")


def check(spark: SparkSession, folder: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(staleness, diff) of the stored hashes and files(path, hash); without stored ones all files are new."""
    stored = load(spark, folder)
    known = stored[1] if stored else spark.createDataFrame([], "path string, hash string")
    return snapshots.staleness(known, hashed(files)), snapshots.diff(known, hashed(files))


def footer(source_hash: str, generated_at: str) -> str:
    """Lines that end a written file and tell what it was made from."""
    return f"---\n*Generated at {generated_at}*\n*Source hash: {source_hash}*\n*Verify: `python -m codeloom verify`*\n"


def footer_hash(text: str | None) -> str | None:
    found = _HASH_LINE.search(text or "")
    return found[1] if found else None


# where anchors are and were: anchor, path, line, location; and the moves


def update_anchors(known: DataFrame, chunks: DataFrame, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(places, moves) after chunks(anchor, path, line, location) have been seen.

    places holds the newest place of every anchor; an anchor on several places is taken
    by its first.  moves holds anchor, old_location, new_location, moved_at of those
    that are elsewhere than known(anchor, path, line, location) says.
    """
    pick = lambda df: df.groupBy("anchor").agg(F.min(F.struct("path", "line", "location")).alias("p")).select("anchor", "p.*")
    old, new = pick(known), pick(chunks)
    j = old.select("anchor", F.struct("path", "line", "location").alias("o")).join(new.select("anchor", F.struct("path", "line", "location").alias("n")), "anchor", "full_outer")
    places = j.select("anchor", F.coalesce("n", "o").alias("p")).select("anchor", "p.path", "p.line", "p.location")
    moved = j.filter((F.col("o.path") != F.col("n.path")) | (F.col("o.line") != F.col("n.line")))
    return places, moved.select("anchor", F.col("o.location").alias("old_location"), F.col("n.location").alias("new_location"), F.lit(at or now()).alias("moved_at"))


def resolve_anchor(places: DataFrame, anchor: str) -> tuple[str, int] | None:
    row = places.filter(F.col("anchor") == anchor).select("path", "line").first()
    return (row.path, row.line) if row else None


def write_anchors(places: DataFrame, moves: DataFrame, at: str) -> None:
    places.write.mode("overwrite").json(os.path.join(at, "places"))
    moves.write.mode("append").json(os.path.join(at, "moves"))


def read_anchors(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema("anchor string, path string, line int, location string").json(os.path.join(at, "places")),
        spark.read.schema("anchor string, old_location string, new_location string, moved_at string").json(os.path.join(at, "moves")),
    )
