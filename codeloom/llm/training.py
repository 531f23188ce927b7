"""Bounded, class-balanced samples of labelled documents, for the models fitted here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import docs_only


def labelled_rows(documents: DataFrame, labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows (doc_id, text, label) of each class, those with the least hash of doc_id.

    Ids with contradicting labels, null labels and null ids or texts are left out;
    repeated rows of an id count once, with the least text.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other")
    )
    chosen = None
    for k in (0, 1):
        part = one.filter(F.col("label") == k).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 x per_class ids, so this side is always small enough to send to every task
    return docs_only(documents).filter("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def labelled(documents: DataFrame, labels: DataFrame, target: str, per_class: int) -> list[tuple[int, str, int]]:
    """labelled_rows() on the driver, by doc_id."""
    return sorted((r.doc_id, r.text, r.label) for r in labelled_rows(documents, labels, target, per_class).collect())
