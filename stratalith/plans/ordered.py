"""Queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered as O
from .catalog import query, read


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents: doc_id, at (from 0), line."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))


_LINES = '''lines AS (SELECT doc_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS "at", unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))'''


@query(f"""WITH {_LINES} SELECT doc_id, "at", last_value(CASE WHEN length(line) > 200 THEN "at" END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS section,
 last_value(CASE WHEN length(line) > 200 THEN "at" END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY "at" ROWS 20 PRECEDING) AS near_section FROM lines""")
def carry_forward_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading above each line: any before it, and one at most 20 lines before."""
    lines, hit = _lines(spark, sf_dir), F.length("line") > 200
    out = O.carry_forward(lines, ["doc_id"], ["at"], hit, F.col("at"), "section")
    return O.carry_forward(out, ["doc_id"], ["at"], hit, F.col("at"), "near_section", within=20).select("doc_id", "at", "section", "near_section")


@query("""WITH g AS (SELECT l_suppkey, l_partkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS d FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
 i AS (SELECT *, sum(CASE WHEN d >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS island FROM g)
 SELECT l_suppkey, CAST(island AS BIGINT) AS island, count(*) AS n, min(l_partkey) AS low, max(l_partkey) AS high FROM i GROUP BY 1, 2""")
def islands_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return O.by_gap(places, ["l_suppkey"], "l_partkey", 20).groupBy("l_suppkey", "island").agg(F.count("*").alias("n"), F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))


@query("""SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_at, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INTEGER) AS step FROM lineitem""")
def span_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each heading to the next, with the step's number."""
    from pyspark.sql import Window

    out = O.spans(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")
    return out.withColumn("step", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_k(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 1).select("user_id", "event_type", "event_id", "ts")


@query("""SELECT p_partkey, CASE WHEN n = 0 THEN p_brand ELSE p_brand || '_' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) - 1 AS n FROM part)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.numbered_names(read(spark, sf_dir, "part"), ["p_size"], "p_brand", ["p_partkey"]).select("p_partkey", "unique_name")


@query("SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 3 AS INTEGER) AS slot FROM events")
def round_robin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.round_robin(read(spark, sf_dir, "events"), ["event_id"], 3, ["event_type"]).select("event_id", "event_type", "slot")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber AS pos, CAST(l_quantity AS INTEGER) % 5 AS lv, CAST(l_partkey AS VARCHAR) AS nm FROM lineitem)
 SELECT a.l_orderkey, a.pos AS "at", a.lv AS level, a.nm AS name, (SELECT b.nm FROM i b WHERE b.l_orderkey = a.l_orderkey AND (b.pos, b.lv, b.nm) < (a.pos, a.lv, a.nm) AND b.lv < a.lv ORDER BY b.pos DESC, b.lv DESC, b.nm DESC LIMIT 1) AS parent FROM i a""")
def parent_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest item before with a smaller level number."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("at"), (F.col("l_quantity").cast("int") % 5).alias("level"), F.col("l_partkey").cast("string").alias("name"))
    return O.parents(items, ["l_orderkey"], "at", "level", "name")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.first_k(read(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n FROM conversations) WHERE n <= 6""")
def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six messages of every conversation."""
    return O.first_k(read(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.col("role")], 6).select("conv_id", "turn", "role")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END DESC, o_totalprice DESC, o_orderkey LIMIT 50")
def impact_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 items of greatest impact (a top-k report), by rank and not by the alphabet."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 4).when(F.col("o_orderpriority") == "2-HIGH", 3).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(1)
    return read(spark, sf_dir, "orders").orderBy(rank.desc(), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")
