"""Operator 1, quality rules: compression bands.

A text that zstandard shrinks far more than language of its length is repetitive;
one that it can't shrink is noise (encoded binary, random strings).  Both the whole
text and its fixed chunks are measured, since a long text can hide a bad half.

Defined results
- null text: as an empty text; empty and very short texts (under 64 bytes) have no
  limits, as no ratio means anything there, and are kept with ratio null;
- very long texts: compressed whole, and in every chunk;
- repeated rows: judged alike, each kept or rejected; null doc_id: judged too;
- empty table: no rows; other columns: ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_only, table
from .kernels import flat, slice_batches

#: (bytes from, least ratio, largest ratio): the limits of texts of that length.
BANDS = (
    (0, None, None),
    (64, 0.40, None),
    (128, 0.36, 1.15),
    (256, 0.32, 0.90),
    (512, 0.28, 0.82),
    (1024, 0.22, 0.75),
    (4096, 0.20, 0.72),
    (16384, 0.18, 0.70),
)
CHUNK_BYTES = 4096
#: A last chunk shorter than this is not measured alone; it still counts in the whole.
LEAST_CHUNK = 1024
#: Random base-64 text is at 0.76, language under 0.6.
CHUNK_LIMITS = (0.15, 0.72)
#: A text is rejected when more than this share of its chunks is outside the limits.
BAD_CHUNKS = 1 / 3
LEVEL = 3

_FIELDS = "doc_id long, n_bytes long, band int, ratio double, chunks int, repetitive_chunks int, incompressible_chunks int, least_chunk double, largest_chunk double, reason string, keep boolean"


def compression_bands(df: DataFrame, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, least_chunk: int = LEAST_CHUNK, chunk_limits=CHUNK_LIMITS, bad_chunks: float = BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """A verdict for every row of df(doc_id, text): ratios, reason and keep."""
    starts = np.array([b[0] for b in bands])
    low = [0.0 if b[1] is None else b[1] for b in bands]
    high = [np.inf if b[2] is None else b[2] for b in bands]

    def judge(batches):
        squeeze = zstandard.ZstdCompressor(level=level, write_content_size=False).compress
        for b in slice_batches(batches):
            data, off = flat(b.column("text"))
            view = memoryview(np.ascontiguousarray(data))
            rows = {k: [] for k in ("n_bytes", "band", "ratio", "chunks", "repetitive_chunks", "incompressible_chunks", "least_chunk", "largest_chunk", "reason", "keep")}
            for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
                n = e - s
                k = int(np.searchsorted(starts, n, "right")) - 1
                ratio = len(squeeze(view[s:e])) / n if n else None
                if n <= chunk_bytes:
                    each = [ratio] if n >= least_chunk else []
                else:
                    each = [len(squeeze(view[p : min(p + chunk_bytes, e)])) / (min(p + chunk_bytes, e) - p) for p in range(s, e, chunk_bytes) if e - p >= least_chunk]
                few = sum(x < chunk_limits[0] for x in each)
                much = sum(x > chunk_limits[1] for x in each)
                if n and ratio < low[k]:
                    why = "repetitive"
                elif n and ratio > high[k]:
                    why = "incompressible"
                elif few > bad_chunks * len(each):
                    why = "repetitive chunks"
                elif much > bad_chunks * len(each):
                    why = "incompressible chunks"
                else:
                    why = None
                for name, x in zip(rows, (n, k, ratio if n >= 64 else None, len(each), few, much, min(each, default=None), max(each, default=None), why, why is None)):
                    rows[name].append(x)
            kinds = {"n_bytes": pa.int64(), "band": pa.int32(), "ratio": pa.float64(), "chunks": pa.int32(), "repetitive_chunks": pa.int32(), "incompressible_chunks": pa.int32(), "least_chunk": pa.float64(), "largest_chunk": pa.float64(), "reason": pa.string(), "keep": pa.bool_()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[k], t) for k, t in kinds.items())], ["doc_id", *kinds])

    return docs_only(df).mapInArrow(judge, _FIELDS)


def kept(df: DataFrame, **parameters) -> DataFrame:
    """The rows of compression_bands that it keeps."""
    return compression_bands(df, **parameters).filter("keep").drop("reason")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the bands keep, with their ratios."""
    return kept(table(spark, sf_dir, "documents"))
