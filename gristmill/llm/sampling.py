"""Bounded samples of labelled rows, and the held-out split of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], folds: int = 5) -> list:
    """(text, label) rows outside the held-out fold, of each class at most so many, picked by a hash of the id.

    Ids that have several labels are left out. The ids picked are bounded by
    `per_class`, and so are their broadcast and the rows collected but for
    documents that repeat an id, of which one text each is taken.
    """
    rated = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(remainder(F.col("doc_id"), folds) != 0)
    rated = rated.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other")
    picked = None
    for value, most in per_class.items():
        own = rated.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")
        picked = own if picked is None else picked.union(own)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min(F.struct("label", F.coalesce("text", F.lit("")).alias("text"))).alias("r")).orderBy("doc_id").select("r.text", "r.label").collect()
