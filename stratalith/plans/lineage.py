"""Lineage queries: suppliers are programs, parts are fields and copybooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage as L
from .catalog import query, read


@query("SELECT DISTINCT 'program_' || l_suppkey AS node_id, 'program' AS node_type, CAST(l_suppkey AS VARCHAR) AS name FROM lineitem UNION SELECT 'field_' || l_partkey, 'field', CAST(l_partkey AS VARCHAR) FROM lineitem")
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nodes(read(spark, sf_dir, "lineitem"), ("l_suppkey", "program"), ("l_partkey", "field"))


@query("SELECT 'program_' || l_suppkey AS source_node, 'field_' || l_partkey AS target_node, l_returnflag AS relationship, count(*) AS weight FROM lineitem GROUP BY 1, 2, 3")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edges(read(spark, sf_dir, "lineitem"), ("l_suppkey", "program"), ("l_partkey", "field"), F.col("l_returnflag"))


@query("SELECT DISTINCT 'field_' || l_partkey AS node_id FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def lineage_inferred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    known = L.nodes(read(spark, sf_dir, "part").where("p_size <= 25"), ("p_partkey", "field")).unionByName(L.nodes(lines, ("l_suppkey", "program")))
    return L.inferred_nodes(L.edges(lines, ("l_suppkey", "program"), ("l_partkey", "field"), F.lit("uses")), known)


_EDGES = "(SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return (lines.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct())


@query(f"""SELECT coalesce(x.node, y.node) AS node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM (SELECT a AS node, count(DISTINCT b) AS n_out FROM {_EDGES} GROUP BY 1) x
 FULL JOIN (SELECT b AS node, count(DISTINCT a) AS n_in FROM {_EDGES} GROUP BY 1) y ON x.node = y.node""")
def call_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.degrees(_edges(spark, sf_dir), "a", "b")


@query(f"SELECT b AS component, a AS neighbour, 'upstream' AS side FROM {_EDGES} UNION SELECT a, b, 'downstream' FROM {_EDGES}")
def impact_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.one_hop(_edges(spark, sf_dir), "a", "b", F.lit(True))


@query(f"""SELECT DISTINCT b AS source, a AS dependent, 'high' AS impact_level, 'interface_change_required' AS change FROM {_EDGES} UNION
 SELECT x.s_nationkey, y.s_nationkey, 'medium', 'data_structure_dependency' FROM (SELECT DISTINCT s_nationkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) x
 JOIN (SELECT DISTINCT s_nationkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) y USING (l_partkey) WHERE x.s_nationkey <> y.s_nationkey""")
def impact_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _edges(spark, sf_dir).select(F.col("a").alias("calling"), F.col("b").alias("called"))
    copies = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_nationkey").alias("program"), F.col("l_partkey").alias("copybook"))
    return L.impacts(calls, copies, F.lit(True))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey // 3 > 0), r AS (SELECT a AS start, b AS node, 1 AS hops FROM e UNION SELECT r.start, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node)
 SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1, 2""")
def closure_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition of this engine: reach over any number of hops."""
    part = read(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 3).alias("b")).where("b > 0")
    return L.within(edges, part.select(F.col("p_partkey").alias("start")), "a", "b")


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 3 AS a, p_partkey AS b FROM part WHERE p_partkey // 3 > 0), r AS (SELECT a AS start, b AS node, 1 AS hops FROM e UNION SELECT r.start, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node)
 SELECT start, count(*) AS n_dependents, CAST(max(hops) AS INTEGER) AS depth, CASE WHEN count(*) > 10 THEN 'HIGH' WHEN count(*) > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r GROUP BY 1""")
def impact_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a change of a part reaches."""
    edges = read(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 3).alias("a"), F.col("p_partkey").alias("b")).where("a > 0")
    return L.impact_chain(edges, "a", "b")


@query("""WITH e AS (SELECT DISTINCT 'program_' || l_suppkey AS a, 'field_' || l_partkey AS b, l_returnflag AS r FROM lineitem), p AS (SELECT DISTINCT a FROM e WHERE b = 'field_7'), f AS (SELECT DISTINCT b FROM e JOIN p USING (a))
 SELECT a AS source_node, b AS target_node, r AS relationship FROM e WHERE a IN (SELECT a FROM p) AND b IN (SELECT b FROM f)""")
def field_lineage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage around one field, two steps wide (the field asked for is the feature)."""
    return L.subgraph(L.edges(read(spark, sf_dir, "lineitem"), ("l_suppkey", "program"), ("l_partkey", "field"), F.col("l_returnflag")), "field_7")


@query("""WITH c AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'N') AS n_read, count(*) FILTER (l_returnflag = 'R') AS n_write, count(*) FILTER (l_returnflag = 'A') AS n_transform, count(DISTINCT l_suppkey) AS n_programs, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS n_writers FROM lineitem GROUP BY 1)
 SELECT *, CASE WHEN n_writers > 1 THEN 'multiple_writers' WHEN n_write = 0 AND n_transform = 0 THEN 'read_only' WHEN n_programs > 1 THEN 'shared' ELSE 'private' END AS pattern FROM c""")
def field_usage_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = F.when(F.col("l_returnflag") == "N", "READ").when(F.col("l_returnflag") == "R", "WRITE").otherwise("TRANSFORM")
    return L.usage_patterns(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", use)


@query("""WITH o AS (SELECT o_custkey % 500 AS file, o_orderkey, CAST(o_orderkey AS VARCHAR) AS program, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'creator' WHEN '2' THEN 'updater' WHEN '3' THEN 'deleter' ELSE 'reader' END AS k FROM orders),
 l AS (SELECT *, lag(k) OVER (PARTITION BY file ORDER BY o_orderkey) AS b FROM o) SELECT file, count(*) AS n_steps, arg_min(program, o_orderkey) AS first_program, arg_max(program, o_orderkey) AS last_program, string_agg(k, '>' ORDER BY o_orderkey) FILTER (b IS NULL OR b <> k) AS journey FROM l GROUP BY 1""")
def file_journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of data through a file: orders stand for accesses, customers for files."""
    head = F.substring("o_orderpriority", 1, 1)
    access = F.when(head == "1", "CREATE").when(head == "2", "UPDATE").when(head == "3", "DELETE").otherwise("READ")
    rows = read(spark, sf_dir, "orders").withColumn("file", F.col("o_custkey") % 500)
    return L.journey(rows, "file", "o_orderkey", ["o_orderkey"], access).withColumn("n_steps", F.col("n_steps").cast("long"))


@query("SELECT DISTINCT CASE WHEN event_type = 'view' THEN event_type ELSE CAST(user_id AS VARCHAR) END AS source, CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE event_type END AS target, 'FILE_' || upper(event_type) AS flow FROM events")
def data_flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.data_flow(read(spark, sf_dir, "events"), "user_id", "event_type", F.concat(F.lit("FILE_"), F.upper("event_type")), F.col("event_type") == "view")


@query("""SELECT user_id, CASE WHEN event_type = 'click' THEN 'updater' WHEN event_type = 'purchase' THEN 'creator' WHEN event_type = 'view' THEN 'reader' WHEN event_type = 'error' THEN 'deleter' ELSE 'reader' END AS class, count(*) AS n FROM events GROUP BY 1, 2""")
def access_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    access = F.when(F.col("event_type") == "click", "UPDATE").when(F.col("event_type") == "purchase", "WRITE").when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "error", "DELETE")
    return read(spark, sf_dir, "events").groupBy("user_id", L.access_class(access, F.lit(None).cast("string")).alias("class")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_-])tion($|[^A-Za-z0-9_-])')")
def field_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.references(read(spark, sf_dir, "documents"), "text", "tion").select("doc_id")


@query("""WITH c AS (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CALL' WHEN '2' THEN 'LINK' WHEN '3' THEN 'FILE_WRITE' WHEN '4' THEN 'FILE_READ' ELSE 'COPY' END AS relation FROM orders)
 SELECT relation, CASE relation WHEN 'FILE_WRITE' THEN 'update' WHEN 'FILE_READ' THEN 'read' ELSE 'reference' END AS step, CASE WHEN relation IN ('CALL', 'LINK') THEN 'HIGH' WHEN relation IN ('FILE_WRITE', 'FILE_READ') THEN 'MEDIUM' ELSE 'LOW' END AS impact, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def relation_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring("o_orderpriority", 1, 1)
    relation = F.when(head == "1", "CALL").when(head == "2", "LINK").when(head == "3", "FILE_WRITE").when(head == "4", "FILE_READ").otherwise("COPY")
    c = read(spark, sf_dir, "orders").groupBy(relation.alias("relation")).agg(F.count("*").alias("n"))
    return c.select("relation", L.step_of(F.col("relation")).alias("step"), L.impact_of(F.col("relation")).alias("impact"), "n")
