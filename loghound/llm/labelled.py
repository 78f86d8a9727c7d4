"""A bounded sample of labelled documents for fitting, the same for every classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most documents of each label in a fitting sample, and the longest text in characters that may be in it.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 40000


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32(doc_id as text) mod 4 is 2 (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS,
               chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) of each label 0 and 1, by a hash of doc_id; sorted, so reruns agree.

    Labels that are null or belong to held-out rows are left out; several
    labels of one document count as the highest, of several texts of one
    document the least is taken.  Only ids are ranked; at most 2 * ``rows`` of
    them are broadcast to pick the texts.
    """
    spark = docs.sparkSession
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    picked = [r for y in (0, 1) for r in
              known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if not picked:
        return []
    ids = spark.createDataFrame([(r["doc_id"], r["y"]) for r in picked], "doc_id long, y int")
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= chars)
             .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect())
    return sorted((r["text"], r["y"]) for r in found)
