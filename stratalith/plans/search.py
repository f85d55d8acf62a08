"""Vector queries: every hundredth vector is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as V
from .catalog import query, read


def _scores(where: str = "true", k: int = 5) -> str:
    return f"""s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND {where}),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id % 100 = 0")


@query(f"WITH {_scores()} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(*_pair(spark, sf_dir), 10)


@query(f"WITH {_scores('q.vec_id <> e.vec_id')} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def vector_self_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar components: the asked one itself is left out."""
    return V.top_k(*_pair(spark, sf_dir), 5, leave_self=True)


@query(f"WITH {_scores()}, h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY rank, query_id) AS n FROM r WHERE rank <= 5) SELECT vec_id, query_id, score FROM h WHERE n = 1")
def multi_query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several queries, each document once."""
    return V.union_search(V.top_k(*_pair(spark, sf_dir), 5), ["rank", "query_id"]).select("vec_id", "query_id", "score")


@query(f"WITH {_scores()} SELECT query_id, r.vec_id, score, round(0.6 * score + 0.4 * greatest(0.0, least(1.0, coalesce(nullif(label, 3) / 5.0, 0.5))), 4)::DOUBLE AS final FROM r JOIN embeddings e ON e.vec_id = r.vec_id WHERE rank <= 10")
def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = _pair(spark, sf_dir)
    hits = V.top_k(rows, queries, 10).join(rows.select("vec_id", "label"), "vec_id")
    return V.reranked(hits, F.nullif("label", F.lit(3)) / 5.0).select("query_id", "vec_id", "score", "final")


@query("SELECT label, count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS least_size, CAST(max(len(embedding)) AS INTEGER) AS most_size, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS mean_norm FROM embeddings GROUP BY label")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size(v)).alias("least_size"), F.max(F.size(v)).alias("most_size"), F.round(F.avg(F.sqrt(V.inner_product(v, v))), 4).alias("mean_norm"))


@query("SELECT doc_id, md5(trim(text) || ' | Purpose: ' || lang || ' | Fields: ' || source || ', ' || lang) AS prepared FROM documents")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the text that is embedded."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(V.embedding_text(F.col("text"), F.col("lang"), F.array("source", "lang"), F.array().cast("array<string>"))).alias("prepared"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN [event_type, 'k' || user_id % 10] ELSE [] END AS l FROM events""".replace("SELECT event_id, CASE", "SELECT event_id, list_contains(l, 'k3') AS has_k, CAST(len(l) AS INTEGER) AS n FROM (SELECT event_id, CASE").replace("FROM events", "FROM events)"))
def metadata_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists out of JSON; whatever is no list is empty."""
    json = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "k'), F.col("user_id") % 10, F.lit('"]'))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", V.text_list(json).alias("l")).select("event_id", F.array_contains("l", "k3").alias("has_k"), F.size("l").alias("n"))


@query("""SELECT vec_id, lang, source, n_chars, label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings JOIN documents ON doc_id = vec_id""")
def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their vectors, as they are exported."""
    v = F.col("embedding")
    joined = V.with_chunks(read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "documents").drop("text"), "vec_id", "doc_id")
    return joined.select("vec_id", "lang", "source", "n_chars", "label", F.round(F.sqrt(V.inner_product(v, v)), 4).alias("norm"))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.q, v.vec_id, v.label, list_inner_product(q.e::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM q JOIN embeddings v ON v.vec_id <> q.q),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5) SELECT q, label AS dependency, count(*) AS n, CAST(min(r) AS INTEGER) AS best_rank FROM t GROUP BY 1, 2""")
def mined_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nearest chunks of each query chunk belong to; queries are the ids divisible by 100, against all rows."""
    e = read(spark, sf_dir, "embeddings")
    hits = V.top_k(e, e.where("vec_id % 100 = 0"), 5, leave_self=True)
    return V.mined(hits, e.select("vec_id", "label"), "label")
