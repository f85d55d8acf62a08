"""Servers, answers, layouts and specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import services as V
from .catalog import query, read


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 25 AS k, o_totalprice <= 200000 AS light FROM orders), n AS (SELECT *, sum(light::INT) OVER (PARTITION BY k ORDER BY o_orderkey) - 1 AS turn FROM t),
 s AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS names, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS least FROM supplier GROUP BY 1)
 SELECT k, o_orderkey, CASE WHEN light THEN names[CAST(turn % len(names) AS BIGINT) + 1] ELSE least END AS server FROM n LEFT JOIN s USING (k)""")
def server_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("k"), "o_totalprice")
    servers = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("server"), F.col("s_acctbal").alias("active"))
    return V.choose(requests, servers, "k", "o_orderkey", "o_totalprice", 200_000).withColumn("k", F.col("k").cast("long"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 20) AS hits, round(count(*) FILTER (value > 20) * 100.0::DOUBLE / greatest(1, count(*)), 4) AS hit_pct FROM events GROUP BY 1")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hit_rate(read(spark, sf_dir, "events"), F.col("value") > 20, "event_type")


@query("""WITH a AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations) SELECT conv_id, turn, md5(CASE WHEN starts_with(text, b) THEN substr(text, length(b) + 1) ELSE text END) AS delta FROM a""")
def answer_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.new_part(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", F.md5("delta").alias("delta"))


_W = "len(regexp_extract_all(' ' || regexp_replace(upper(t), '[^A-Z0-9_]', '  ', 'g') || ' ', ' ({}) '))"


@query(f"SELECT doc_id, CAST(len(string_split(t, chr(10))) AS INTEGER) AS n_lines, CAST({_W.format('SELECT|INSERT|UPDATE|DELETE')} AS INTEGER) AS n_sql, CAST({_W.format('PERFORM')} AS INTEGER) AS n_perform, CAST({_W.format('IF')} AS INTEGER) AS n_if FROM (SELECT doc_id, replace(replace(text, ' the ', ' if '), ' de ', ' select ') AS t FROM documents)")
def technical_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frequent words stand for IF and SELECT, which the texts lack."""
    t = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" if ")), F.lit(" de "), F.lit(" select "))
    return V.technical_specs(read(spark, sf_dir, "documents").select("doc_id", t.alias("text")), "doc_id", "text")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'both' WHEN event_type = 'view' THEN 'db2_to_file' ELSE 'file_to_db2' END AS direction FROM events")
def db2_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("event_type") == "purchase", "both")
    return read(spark, sf_dir, "events").select("event_id", V.direction(marked, F.when(F.col("event_type") == "view", "READ").otherwise("WRITE")).alias("direction"))


@query("""SELECT s_suppkey, round(greatest(0.0, (s_acctbal / 1000 * 25 + (100 - s_suppkey % 101) * 0.8 + (100 - s_nationkey) * 0.3 + (3 - s_suppkey % 4) * 15 + greatest(0, (20 - s_suppkey % 31) * 2) + (s_suppkey % 100) * 0.1
 + CASE WHEN s_suppkey % 7 > 0 THEN greatest(0.0, (400 - 70 * (s_suppkey % 7)) * 0.05) ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE (s_suppkey % 90 - 50) * 0.2 END + 5 * 2 + CASE WHEN s_nationkey > 0 THEN 20 ELSE 0 END)::DOUBLE), 4)::DOUBLE AS score FROM supplier""")
def device_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of how free devices are: suppliers stand for them."""
    k = F.col("s_suppkey")
    score = V.device_score(F.col("s_acctbal") / 1000, k % 101, F.col("s_nationkey"), k % 4, F.lit(3), k % 31, k % 100, 70 * (k % 7), F.when(k % 3 != 0, k % 90), F.lit(5), F.col("s_nationkey"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.round(score, 4).alias("score"))


@query("SELECT event_id, event_type, ts FROM events WHERE value >= 90 AND event_type <> 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def open_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the last day that are not resolved."""
    from ..operators.reports import since

    return since(read(spark, sf_dir, "events"), "ts", "24 hours").where("value >= 90 and event_type <> 'error'").select("event_id", "event_type", "ts")


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size, max(doc_id) AS newest FROM documents GROUP BY 1, 2")
def upload_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"), F.max("doc_id").alias("newest"))
