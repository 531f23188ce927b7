"""Incremental parsing: a stream of changed files kept as tables.

Each micro-batch parses its files and writes their rows under its number, so a batch
that runs again after a failure overwrites itself.  The current rows of a file are
those of its last batch; compact() rewrites a table without the older ones.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse

FILE_FIELDS = "path string, language string, hash string, source string"
PARSERS = {"chunks": parse.chunks, "imports": parse.imports}


class IncrementalTables:
    """files, chunks and imports under a folder; a file with a null source is removed."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def _path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def write(self, batch: DataFrame, number: int) -> None:
        """Parses the files of one batch, those aside whose hash is the known one; of several rows of a file in it the greatest hash counts."""
        one = batch.groupBy("path").agg(F.max_by(F.struct("language", "hash", "source"), F.coalesce("hash", F.lit(""))).alias("f")).select("path", "f.*")
        known = self.current("files", before=number)
        if known is not None:
            same = known.select("path", F.col("hash").alias("known"))
            one = one.join(same, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("known"))).drop("known")
        one = one.persist()
        try:
            put = lambda name, df: df.write.mode("overwrite").parquet(f"{self._path(name)}/batch={number}")
            for name, parser in PARSERS.items():
                put(name, parser(one.filter("source is not null")))
            put("files", one.select("path", "language", "hash", F.col("source").isNull().alias("removed")))
        finally:
            one.unpersist()

    def current(self, name: str, before: int | None = None) -> DataFrame | None:
        """Rows of a table as of the last batch (before a number); None where nothing is written."""
        if not self._exists("files"):
            return None
        old = F.col("batch") < (before if before is not None else 1 << 60)
        f = self.spark.read.parquet(self._path("files")).filter(old)
        last = f.groupBy("path").agg(F.max_by(F.struct("batch", "language", "hash", "removed"), "batch").alias("f")).select("path", "f.*").filter("not removed")
        if name == "files":
            return last.select("path", "language", "hash")
        rows = self.spark.read.parquet(self._path(name)).filter(old)
        return rows.join(last.select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def compact(self, to: str) -> IncrementalTables:
        """The current rows as batch 0 of a new folder."""
        files = self.current("files")
        if files is not None:
            files.withColumn("removed", F.lit(False)).write.mode("overwrite").parquet(os.path.join(to, "files", "batch=0"))
            for name in PARSERS:
                self.current(name).write.mode("overwrite").parquet(os.path.join(to, name, "batch=0"))
        return IncrementalTables(self.spark, to)


def follow(spark: SparkSession, incoming: str, tables: IncrementalTables, checkpoint: str, files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Feeds parquet files of FILE_FIELDS that arrive in a folder into the tables."""
    stream = spark.readStream.schema(FILE_FIELDS).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: tables.write(df, n))
    return (writer.trigger(availableNow=True) if once else writer).start()
