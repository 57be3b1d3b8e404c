"""Labels of documents, and bounded, documented samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo modulus."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def label_rows(labels: DataFrame, label: str, usable) -> DataFrame:
    """(doc_id, y) of all usable labels: no null labels or doc_ids; of rows that repeat a doc_id one with the largest label counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(usable)
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most bound labelled rows, chosen by a hash of doc_id.

    Null labels, null doc_ids and null texts are left out; of rows that repeat
    a doc_id in labels one with the largest label counts.  The chosen ids are
    at most bound rows, so the join broadcasts them.
    """
    ids = label_rows(labels, label, usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(ids), "doc_id")
