"""Which labelled rows a classifier learns from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, of: int) -> Column:
    """CRC-32 of the key's text, modulo ``of``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of))


def sample(labels: DataFrame, label: str, most: int, key: str = "doc_id", learnt: Column | None = None) -> DataFrame:
    """``doc_id, y``: at most ``most`` keys with a 0/1 label, chosen by a hash of the key.

    A key with several labels counts as 0 if any of them is 0.  Null keys and labels are left out.  ``learnt``
    restricts the keys.  The bound is what allows the result to be broadcast.
    """
    rows = labels.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")) \
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if learnt is not None:
        rows = rows.filter(learnt)
    return rows.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_labels(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, y`` of the documents that the bounded sample names; texts are not shuffled."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")) \
        .join(F.broadcast(labelled), "doc_id")
