"""Learning rows: a bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for tests: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """doc_id, text and y of at most max_rows labelled documents that are not held out.

    The ids with the least hashes are taken, so the sample depends on the data
    alone; of rows that repeat an id the greatest text is taken.  Its size is bounded by max_rows (the documented bound of every
    model here), which is what makes the broadcast below safe.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    y = y.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y"))
