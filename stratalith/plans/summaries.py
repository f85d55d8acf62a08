"""Facts of fields, findings, averages, batches with errors and chunks of layouts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summaries as Y
from .catalog import query, read


@query("""WITH u AS (SELECT l_suppkey AS field, l_partkey::VARCHAR AS p, l_returnflag AS o, l_shipdate AS seen FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY seen DESC, p, o) AS n FROM u)
 SELECT field, count(*) AS uses, string_agg(DISTINCT p, ',' ORDER BY p) AS programs, string_agg(DISTINCT o, ',' ORDER BY o) AS operations, max(seen) AS last_used, string_agg(CASE WHEN n <= 5 THEN p || ':' || o END, ',' ORDER BY n) AS recent FROM r GROUP BY field""")
def field_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.field_facts(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_returnflag", "l_shipdate")
    return out.withColumns({c: F.array_join(c, ",") for c in ("programs", "operations", "recent")})


@query("""WITH c AS (SELECT l_suppkey::VARCHAR AS a, (l_partkey % 97)::VARCHAR AS b, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), d AS (SELECT a AS name, sum(n) AS calls, count(*) AS n FROM c GROUP BY 1), u AS (SELECT b AS name, sum(n) AS calls, count(*) AS n FROM c GROUP BY 1),
 f AS (SELECT l_suppkey::VARCHAR AS name, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1), s AS (SELECT s_suppkey::VARCHAR AS name FROM supplier)
 SELECT name, coalesce(nullif(concat_ws(chr(10), CASE WHEN d.n IS NOT NULL OR u.n IS NOT NULL THEN 'Program Integration: ' || coalesce(d.calls, 0)::BIGINT || ' outbound calls, ' || coalesce(u.calls, 0)::BIGINT || ' inbound calls' END,
  CASE WHEN f.n IS NOT NULL THEN 'Data Flow: Accessed by ' || f.n || ' programs' END, CASE WHEN d.n IS NOT NULL OR u.n IS NOT NULL THEN 'Lineage Impact: ' || coalesce(u.n, 0) || ' upstream dependencies, ' || coalesce(d.n, 0) || ' downstream impacts' END), ''),
  'Analysis completed with comprehensive component assessment') AS summary FROM s LEFT JOIN d USING (name) LEFT JOIN u USING (name) LEFT JOIN f USING (name)""")
def executive_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    calls = items.where("l_linenumber = 1").select(F.col("l_suppkey").alias("calling"), (F.col("l_partkey") % 97).alias("called"))
    access = items.where("l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("program"))
    return Y.findings(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name")), calls, access)


@query("""WITH m AS (SELECT *, max(ts) OVER () AS now FROM events) SELECT event_type, coalesce(round(avg(CASE WHEN ts >= now - INTERVAL 6 HOUR THEN value END), 6), 0) AS average, count(CASE WHEN ts >= now - INTERVAL 6 HOUR THEN 1 END) AS n FROM m GROUP BY event_type""")
def metric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.averages(read(spark, sf_dir, "events"), "event_type", "value", "ts").withColumn("average", F.round("average", 6))



@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 THEN (100 // (p_size % 7))::VARCHAR END AS result,
 CASE WHEN p_size % 5 = 0 THEN 'no result' WHEN p_size % 7 = 0 THEN 'ZeroDivisionError' END AS error FROM part""")
def batch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def checked(row: dict) -> object:
        """Stands for the analysis of a source: fails for some, and finds nothing in others."""
        return None if row["p_size"] % 5 == 0 else 100 // (row["p_size"] % 7)

    found = Y.attempted(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", checked)
    return found.withColumn("error", F.substring_index("error", ":", 1))


@query("""WITH a AS (SELECT count(*) AS n, count(*) FILTER (p_size % 5 <> 0 AND p_size % 7 <> 0) AS k, count(*) FILTER (p_size % 5 = 0) AS none, count(*) FILTER (p_size % 5 <> 0 AND p_size % 7 = 0) AS zero FROM part)
 SELECT n, k AS succeeded, n - k AS failed, round(100.0 * k / greatest(n, 1), 2)::DOUBLE AS success_rate, CASE WHEN none >= zero THEN 'no result' ELSE 'ZeroDivisionError' END AS common_error FROM a""")
def batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.batch_report(batch_attempts(spark, sf_dir))


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS place, CASE WHEN l_partkey % 4 = 0 THEN 24 ELSE 0 END + length('   COMMENT ' || l_suppkey) + 1 AS size, CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS field FROM lineitem),
 r AS (SELECT k, place, 1 AS chunk, size AS total, field AS fields, size, field FROM l WHERE place = 1
  UNION ALL SELECT l.k, l.place, CASE WHEN total + l.size > 60 AND fields >= 1 THEN chunk + 1 ELSE chunk END, CASE WHEN total + l.size > 60 AND fields >= 1 THEN l.size ELSE total + l.size END, CASE WHEN total + l.size > 60 AND fields >= 1 THEN l.field ELSE fields + l.field END, l.size, l.field
   FROM r JOIN l ON l.k = r.k AND l.place = r.place + 1)
 SELECT k AS program, chunk::INTEGER AS chunk, min(place)::INTEGER AS first, max(place)::INTEGER AS last, sum(size)::BIGINT AS n_chars, sum(field)::BIGINT AS n_fields FROM r GROUP BY k, chunk""")
def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts with a line for each line item in chunks of 60 characters with a field at least."""
    at = F.expr("row_number() over (partition by l_orderkey order by l_partkey, l_linenumber, l_suppkey)")
    text = F.expr("concat(if(l_partkey % 4 = 0, '  05 FIELD-NAME PIC X(7)', ''), '   COMMENT ', l_suppkey)")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("program"), at.alias("at"), text.alias("text"))
    return Y.layout_chunks(lines, "program", "at", "text", 60, 1)
