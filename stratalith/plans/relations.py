"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as J
from .catalog import query, read


_SHARING = """WITH u AS (SELECT DISTINCT {c} AS c, {t} AS t FROM {f}), s AS (SELECT c, list(t ORDER BY t) AS ts FROM u GROUP BY 1), k AS (SELECT ts, min(c) AS a FROM s GROUP BY 1), o AS (SELECT u.* FROM u JOIN k ON k.a = u.c)
 SELECT k.a, s.c AS b, 'same_targets' AS kind FROM s JOIN k USING (ts) WHERE k.a <> s.c UNION ALL SELECT DISTINCT x.c, y.c, 'shares' FROM o x JOIN o y ON x.t = y.t AND x.c < y.c"""


@query(_SHARING.format(c="l_suppkey", t="l_partkey", f="lineitem"))
def shared_copybook_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that share a target: classes of equal sets, and pairs of classes."""
    return J.sharing(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("""SELECT DISTINCT r.user_id, r.event_type AS source, w.event_type AS sink FROM events r JOIN events w ON r.user_id = w.user_id AND r.event_type <> w.event_type
 WHERE r.event_type IN ('view', 'click') AND w.event_type NOT IN ('view', 'click')""")
def file_flow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a component reads against what it writes."""
    return J.flows(read(spark, sf_dir, "events"), "user_id", "event_type", F.col("event_type").isin("view", "click"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '1-URGENT')")
def semi_join_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = read(spark, sf_dir, "orders").where((F.col("o_totalprice") > 400000) | (F.col("o_orderpriority") == "1-URGENT"))
    return J.having(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), big.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are referred to but have no definition (customers in debt count as undefined)."""
    named = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return J.lacking(named, read(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def embedding_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are still to be worked on."""
    return J.lacking(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@query("""WITH d AS (SELECT s_suppkey AS component, count(DISTINCT l_partkey) AS n_required, count(DISTINCT CASE WHEN p_size > 40 THEN l_partkey END) AS n_missing FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1)
 SELECT component, n_required, n_missing, round(1 - n_missing::DOUBLE / greatest(1, n_required), 4) AS confidence FROM d""")
def missing_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each component how many of its targets are unknown, and how far its picture can be trusted."""
    needs = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_partkey").alias("target"))
    known = read(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("target"))
    return J.completeness(needs, known, "component", "target")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("""SELECT DISTINCT a.t AS name, b.t AS other FROM (SELECT DISTINCT p_type AS t FROM part) a JOIN (SELECT DISTINCT upper(split_part(p_type, ' ', 1)) AS t FROM part) b ON contains(upper(a.t), b.t) OR contains(b.t, upper(a.t))""")
def bidirectional_substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names one of which contains the other; joined by shared trigrams, so no pair without any is looked at."""
    types = read(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct()
    firsts = types.select(F.upper(F.split("name", " ")[0]).alias("other")).distinct()
    return J.contained(types, "name", firsts, "other")


@query("""SELECT coalesce(a.n, b.n) AS name, a.n IS NOT NULL AS on_left, b.n IS NOT NULL AS on_right FROM (SELECT DISTINCT upper(replace(regexp_replace(c_name, '[.](DAT|TXT|CSV)$', ''), '-', '_')) AS n FROM customer) a
 FULL JOIN (SELECT DISTINCT upper(replace(regexp_replace(replace(s_name, 'Supplier', 'Customer'), '[.](DAT|TXT|CSV)$', ''), '-', '_')) AS n FROM supplier) b ON a.n = b.n""")
def full_outer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names against table names, each brought to a common form."""
    left = read(spark, sf_dir, "customer").select(J.mapped_name(F.col("c_name")).alias("name")).distinct()
    right = read(spark, sf_dir, "supplier").select(J.mapped_name(F.replace(F.col("s_name"), F.lit("Supplier"), F.lit("Customer"))).alias("name")).distinct()
    return J.both_sides(left, right, "name")


@query(_SHARING.format(c="user_id", t="event_type", f="events"))
def related_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for few, very frequent targets."""
    return J.sharing(read(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT p_partkey, p_name, CASE WHEN upper(p_brand) = 'BRAND#1' THEN 0 ELSE 1 END AS rank FROM part WHERE contains(upper(p_brand), 'BRAND#1')")
def equality_or_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a name or a part of it, exact ones first."""
    return J.equal_or_containing(read(spark, sf_dir, "part"), "p_brand", " Brand#1").select("p_partkey", "p_name", "rank")


@query("""WITH known AS (SELECT DISTINCT p_name AS n FROM part), asked AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS q FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT c_name FROM customer),
 m AS (SELECT q, n, CASE WHEN upper(n) = upper(q) THEN 1 WHEN starts_with(upper(n), upper(q)) THEN 2 WHEN ends_with(upper(n), upper(q)) THEN 3 ELSE 4 END AS r FROM asked JOIN known ON contains(upper(n), upper(q)) WHERE q <> ''),
 b AS (SELECT q, arg_min(n, (r, n)) AS n, min(r) AS r FROM m GROUP BY 1) SELECT asked.q AS asked, b.n AS match, ['exact match', 'starts with', 'ends with', 'contains'][b.r] AS how FROM asked LEFT JOIN b USING (q) WHERE asked.q <> ''""")
def component_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which known component a name means, by the strongest way in which one matches."""
    part = read(spark, sf_dir, "part")
    words = part.select(F.explode(F.slice(F.split("p_name", " "), 1, 2)).alias("p_name")).union(read(spark, sf_dir, "customer").select("c_name")).where("p_name <> ''")
    return J.probe(part, words, "p_name")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def adaptive_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted columns as far as the table has them."""
    return J.present(read(spark, sf_dir, "supplier"), "s_suppkey", "parameters", "S_NAME", "conditional_call", "s_acctbal").toDF("s_suppkey", "s_name", "s_acctbal")
