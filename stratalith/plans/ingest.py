"""Catalogue, routing and name queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import chunks as C
from ..operators import ordered as O
from ..operators import reports as R
from ..sources import files
from ..streaming import windows as W
from .catalog import query, read


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https://%.example.org/%' OR url LIKE '%.html'")
def name_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where(N.glob(F.col("url"), ["https://*.example.org/*", "*.html"])).select("page_id", "url")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'cobol' WHEN 1 THEN 'jcl' WHEN 2 THEN 'data' ELSE 'other' END AS folder FROM part")
def target_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files go by their ending."""
    kind = F.col("p_size") % 4
    name = F.concat(F.lit("f."), F.when(kind == 0, "CBL").when(kind == 1, "jcl").when(kind == 2, "csv").otherwise("xyz"))
    return read(spark, sf_dir, "part").select("p_partkey", files.target_folder(name).alias("folder"))


@query("""WITH n AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'TO' WHEN 1 THEN 'PIC' WHEN 2 THEN 'HIGH-VALUES' WHEN 3 THEN '12-34' WHEN 4 THEN 'CUSTOMER-' || upper(split_part(p_name, ' ', 1)) || '-LONG' WHEN 5 THEN 'A-VERY-LONG-NAME-OF-NOTHING' ELSE upper(split_part(p_name, ' ', 1)) END AS n FROM part)
 SELECT p_partkey, length(n) >= 2 AND n NOT IN ('IF', 'THEN', 'ELSE', 'END', 'MOVE', 'TO', 'FROM', 'COMPUTE', 'PERFORM', 'UNTIL', 'VARYING', 'BY', 'CALL', 'USING', 'RETURNING', 'PIC', 'PICTURE', 'VALUE', 'OCCURS', 'REDEFINES', 'DEPENDING') AND regexp_matches(replace(n, '-', ''), '^[A-Z0-9]+$') AS field_ok,
  length(n) > 2 AND n NOT IN ('VALUE', 'PIC', 'THE', 'TO', 'FROM', 'HIGH-VALUES', 'LOW-VALUES') AND regexp_matches(n, '^[A-Z][A-Z0-9-]*$') AND (length(n) <= 15 OR starts_with(n, 'CUSTOMER')) AS file_ok,
  length(n) > 2 AND n NOT IN ('VALUE', 'PIC', 'THE', 'TO', 'FROM', 'HIGH-VALUES', 'LOW-VALUES') AND regexp_matches(n, '^[A-Z][A-Z0-9-]*$') AND (length(n) <= 30 OR starts_with(n, 'CUSTOMER')) AS storage_ok FROM n""")
def valid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    word, k = F.upper(F.split("p_name", " ")[0]), F.col("p_size") % 8
    n = F.when(k == 0, "TO").when(k == 1, "PIC").when(k == 2, "HIGH-VALUES").when(k == 3, "12-34").when(k == 4, F.concat(F.lit("CUSTOMER-"), word, F.lit("-LONG"))).when(k == 5, "A-VERY-LONG-NAME-OF-NOTHING").otherwise(word)
    return read(spark, sf_dir, "part").select("p_partkey", N.valid_field(n).alias("field_ok"), N.valid_file(n).alias("file_ok"), N.valid_file(n, F.lit("WORKING-STORAGE SECTION")).alias("storage_ok"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c)
 SELECT source, lang AS dominant, CASE lang WHEN 'en' THEN 'program' WHEN 'de' THEN 'jcl' ELSE 'copybook' END AS component_type FROM r WHERE k = 1""")
def dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component's type by its most frequent kind of chunk."""
    counts = R.histogram(read(spark, sf_dir, "documents"), "source", "lang")
    top = O.first_k(counts, ["source"], [F.desc("n"), F.col("lang")], 1)
    return top.select("source", F.col("lang").alias("dominant"), F.when(F.col("lang") == "en", "program").when(F.col("lang") == "de", "jcl").otherwise("copybook").alias("component_type"))


@query("""WITH l AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30) SELECT o_orderkey, o_orderdate, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS step FROM l""")
def comparison_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty entries of a log, oldest first (a top-k report)."""
    from pyspark.sql import Window

    last = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30)
    return last.withColumn("step", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")))


@query("""SELECT c.c_custkey, c.c_name, n.n, n.total, CASE WHEN n.n IS NULL THEN 'not_found' ELSE 'table' END AS found_as FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) n ON n.o_custkey = c.c_custkey""")
def component_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue entry with its data, by a left join; columns are taken by name."""
    data = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    out = read(spark, sf_dir, "customer").join(data, "c_custkey", "left")
    return out.select("c_custkey", "c_name", "n", "total", F.when(F.col("n").isNull(), "not_found").otherwise("table").alias("found_as"))


@query("""SELECT 'c_acctbal' AS "column", 'REAL' AS sql_type, count(*) FILTER (c_acctbal IS NULL) AS n_null, count(DISTINCT c_acctbal) AS n_distinct FROM customer UNION ALL SELECT 'c_custkey', 'INTEGER', count(*) FILTER (c_custkey IS NULL), count(DISTINCT c_custkey) FROM customer
 UNION ALL SELECT 'c_mktsegment', 'VARCHAR(' || least(floor(max(length(c_mktsegment)) * 1.2), 1000)::INT || ')', count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment) FROM customer
 UNION ALL SELECT 'c_name', 'VARCHAR(' || least(floor(max(length(c_name)) * 1.2), 1000)::INT || ')', count(*) FILTER (c_name IS NULL), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_nationkey', 'INTEGER', count(*) FILTER (c_nationkey IS NULL), count(DISTINCT c_nationkey) FROM customer""")
def csv_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that is inferred for a data file."""
    return files.profile(read(spark, sf_dir, "customer")).select("column", "sql_type", "n_null", "n_distinct")


@query()
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines in chunks of at most 3000 characters; tests hold it against a plain loop."""
    out = C.packed_lines(read(spark, sf_dir, "documents"), "doc_id", "text", 3000)
    return out.select("doc_id", "chunk", "first_line", "n_lines", F.length("text").alias("n_chars"))


@query("SELECT event_id, event_type, value, CASE WHEN value >= 90 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE event_type = 'click' AND value >= 60")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from a stream of metrics against a table of limits."""
    limits = spark.createDataFrame([("click", 60.0, 90.0)], "metric string, warning double, critical double")
    return W.run_once(spark, W.alerts(W.stream_of(spark, sf_dir, "events"), limits, "event_type", "value").select("event_id", "event_type", "value", "severity"), "append")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, round(var_pop(l_quantity), 4) AS variance, count(*) FILTER (l_quantity < 3) AS low, count(*) FILTER (l_quantity >= 3 AND l_quantity < 7) AS medium, count(*) FILTER (l_quantity >= 7) AS high FROM lineitem GROUP BY 1")
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(q), 4).alias("mean"), F.round(F.var_pop(q), 4).alias("variance"), F.count_if(q < 3).alias("low"), F.count_if((q >= 3) & (q < 7)).alias("medium"), F.count_if(q >= 7).alias("high"))


@query("""SELECT a.o_orderpriority AS a, b.o_orderpriority AS b, round(a.m - b.m, 4) AS mean_diff, a.n - b.n AS count_diff FROM (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1) a
 JOIN (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1) b ON a.o_orderpriority < b.o_orderpriority""")
def program_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of programs side by side; the programs compared are few classes."""
    g = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    a, b = g.select(*[F.col(c).alias(f"{c}_a") for c in g.columns]), g.select(*[F.col(c).alias(f"{c}_b") for c in g.columns])
    return a.join(b, F.col("o_orderpriority_a") < F.col("o_orderpriority_b")).select(F.col("o_orderpriority_a").alias("a"), F.col("o_orderpriority_b").alias("b"), F.round(F.col("m_a") - F.col("m_b"), 4).alias("mean_diff"), (F.col("n_a") - F.col("n_b")).alias("count_diff"))
