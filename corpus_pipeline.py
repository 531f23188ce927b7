"""A training-data pipeline over documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gets what the one before it kept, as
written and read again.  All but the last return the columns of documents.

1. quality classifier: documents that the quadratic discriminant rejects go;
2. n-gram Jaccard join: of each group of near duplicates the least doc_id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scans: linked credential parts are redacted in the text, n_chars follows;
5. best-fit packing: every document that is left, in bins of 2048 tokens.

Defined results
- null, empty and very long texts, null ids, repeated rows, ties and extra columns are
  treated as each operator's docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontamination, ngram_join, packing, quality_classifier, secret_scan
from codeloom.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", redacted),
    ("best-fit packing", bins),
]

#: The classifier, the join and the packing can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
