"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame; it is written as Parquet and read again before
the next one starts.  All but the last return the columns of documents.

Tables that a stage needs on its way are deleted before it returns; of the
stages that look for duplicates only what they decided stays, until Python ends.

Edge cases, alike for all stages: a null text counts as empty and an empty one
as clean; a text of any length is taken whole; rows that repeat an id, or have
none, are told apart by their texts; equal rows are one document.  An empty
table gives an empty result, but the first stage needs labelled rows to learn
from.  Ties: of equal texts the longest, then the smallest id stays.  Other
columns go through unchanged, whatever their names, but n_chars, which is
counted anew where a text is cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.llm import exact_dedup, near_dedup, packing, quality_gam, substring_dedup, token_counts
from stratalith.llm.common import delete, fresh, prepare, settled, shared_dir

#: Similarity of shingle sets, in percent, from which documents are near duplicates in the pipeline.
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    prepare(spark)
    model = quality_gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document of each group with equal texts; a row is named by its id, if any, its text and its length."""
    sha, key_id, none, size = key = fresh(docs, "sha", "id", "none", "size")

    def named(rows: DataFrame, text_sha: Column) -> DataFrame:
        return rows.withColumns({sha: text_sha, key_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.col("doc_id").isNull()})

    rows = named(docs, F.sha2(exact_dedup.normalised(F.col("text")), 256)).withColumn(size, F.coalesce(F.length("text"), F.lit(0)))
    kept = settled(spark, "kept", lambda: named(exact_dedup.exact_duplicates(docs).where("kept"), F.col("text_sha256")).select(*key[:3]))
    longest = rows.join(kept, key[:3], "left_semi")
    # Rows of one id and text may differ in white space: the longest is the one that was kept.
    return longest.withColumn(key_id, F.row_number().over(Window.partitionBy(*key[:3]).orderBy(F.col(size).desc()))).where(F.col(key_id) == 1).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; rows that share an id are apart."""
    (row,) = fresh(docs, "row")
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    of = rows.select(F.col(row).alias("doc_id"), "text")
    kept = settled(spark, "kept", lambda: near_dedup.near_duplicates(of, PERCENT).where("kept").select(F.col("doc_id").alias(row)).distinct())
    return rows.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents have; one without an id is placed by a hash of its text."""
    (own,) = fresh(docs, "own")
    rows = docs.withColumns({own: F.col("doc_id"), "doc_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))})
    found = settled(spark, "cuts", lambda: substring_dedup.cuts(rows))
    return substring_dedup.without(rows, found).withColumn("doc_id", F.col(own)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the packed sequences."""
    return packing.best_fit(token_counts.token_lengths(docs))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("packing", pack)]
#: SQL has neither the model nor MinHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; a stage's folder goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
