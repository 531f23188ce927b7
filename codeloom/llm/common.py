"""Small helpers of the corpus operators: tables, columns, filters of ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut  # noqa: F401
from .kernels import mix

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_only(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and the named columns alone, so that no other column can clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in extra])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, in any case of letters."""
    known = {c.lower() for c in df.columns}
    while name in known:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class IdFilter:
    """A Bloom filter of ids that tells tasks which rows a later join may need.

    It only spares rows the shuffle: it lets others through by chance and never holds
    one back, so results are the same without it.  Its size is fixed at 8 MB: three of
    2^26 bits an id, set by an aggregation.  Of other ids it lets through about 0.2 %
    beside 3 million, 40 % beside 30 million and nearly all beside 200 million, where
    the join does the whole work.
    """

    BITS, HASHES = 1 << 26, 3

    def __init__(self, ids: DataFrame, column: str = "doc_id"):
        def places(batches):
            for b in batches:
                bit = np.concatenate([self._bit(b.column("id").to_numpy(), k) for k in range(self.HASHES)])
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 6, pa.int32()), pa.array(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

        found = ids.select(F.col(column).alias("id")).mapInArrow(places, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(self.BITS // 64, np.uint64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        self.sent = ids.sparkSession.sparkContext.broadcast(words)

    @classmethod
    def _bit(cls, ids: np.ndarray, k: int) -> np.ndarray:
        return (mix(np.ascontiguousarray(ids).view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(cls.BITS - 1)).astype(np.int64)

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for k in range(self.HASHES):
            bit = self._bit(ids, k)
            ok &= (self.sent.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return ok
