"""Exact vector search in blocks, hashing embedder, text preparation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block.
BLOCK = 4096


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) as blocks: ids and all vectors behind each other, some ``size`` rows of a batch in each; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids, v = part.column(0), part.column(1)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.ListArray.from_arrays(pa.array([0, len(v.flatten())], pa.int32()), v.flatten())], ["ids", "vs"])

    return df.mapInArrow(run, "ids array<long>, vs array<double>")


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", leave_self: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, rank): the k rows of greatest inner product for every query, least id first on ties of the rounded score.

    The query set is stated by the caller.  Blocks of at most BLOCK queries meet blocks of rows, each pair in a task, and of a
    pair only the best k for each query go on; neither the driver nor a task holds all queries.
    """
    def vectors(df: DataFrame) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    asked = _packed(vectors(queries).repartition("id"), BLOCK).select(F.col("ids").alias("qids"), F.col("vs").alias("qvs"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                mine, vs, ids, qvs = (batch.column(c).slice(pair, 1).flatten().to_numpy() for c in range(4))
                score = np.round(qvs.reshape(len(ids), -1) @ vs.reshape(len(mine), -1).T, digits)
                if leave_self:
                    score[ids[:, None] == mine[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(mine, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                keep = np.isfinite(best).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, order.shape[1])[keep]), pa.array(mine[order].ravel()[keep]), pa.array(best.ravel()[keep])], ["query_id", "vec_id", "score"])

    out = _packed(vectors(rows), 2048).crossJoin(asked).mapInArrow(scored, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def with_chunks(vectors: DataFrame, chunks: DataFrame, vector_id: str, chunk_id: str) -> DataFrame:
    """Vectors with the chunks that they stand for; vectors without one are left out, chunks without one too."""
    return vectors.join(chunks.withColumnRenamed(chunk_id, vector_id), vector_id)


def mined(hits: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """What each query depends on, by its hits: the owners of the hit chunks, how many hits each has and its best rank."""
    rows = hits.join(owners, "vec_id")
    return rows.groupBy(F.col("query_id").alias("q"), F.col(owner).alias("dependency")).agg(F.count("*").alias("n"), F.min("rank").alias("best_rank"))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def union_search(hits: DataFrame, order: list[str]) -> DataFrame:
    """Hits of several phrasings, each document once, as it was first seen."""
    w = Window.partitionBy("vec_id").orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reranked(hits: DataFrame, relevance: Column, digits: int = 4) -> DataFrame:
    """0.6 of the similarity and 0.4 of the relevance (0.5 where it is not known, between 0 and 1)."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(relevance, F.lit(0.5))))
    return hits.withColumn("final", F.round(0.6 * F.col("score") + 0.4 * r, digits))


def embedding_text(content: Column, purpose: Column, fields: Column, operations: Column) -> Column:
    """What is embedded: the content, its purpose, the first ten fields and the first five operations."""
    def part(label: str, c: Column) -> Column:
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))

    return F.concat_ws(" | ", F.trim(content), part("Purpose: ", purpose), part("Fields: ", F.array_join(F.slice(fields, 1, 10), ", ")), part("Operations: ", F.array_join(F.slice(operations, 1, 5), ", ")))


def text_list(value: Column) -> Column:
    """A JSON list of texts, or an empty list for anything else."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def hashed_embedding(words: Column, size: int = 64) -> Column:
    """A stand-in for an embedding model: counts of word hashes, scaled to length one; zeros without words."""
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
