"""Report queries (components are suppliers or customers, targets are parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from .catalog import query, read


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS n_components, count(*) AS n_operations,
 string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag_set, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS l_linestatus_set
 FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""")
def master_targets_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that more than one component works on, with the kinds of work."""
    return R.shared_targets(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


_OPS = "SELECT o_custkey AS c_custkey, o_orderpriority AS op, o_orderstatus AS field FROM orders"


def _customer_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ops = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("op"), F.col("o_orderstatus").alias("field"))
    return read(spark, sf_dir, "customer"), ops


@query(f"""WITH o AS ({_OPS}) SELECT c.c_custkey, coalesce(a.n, 0) AS n_operations, coalesce(a.k, 0) AS n_kinds, coalesce(a.f, 0) AS n_fields FROM customer c
 LEFT JOIN (SELECT c_custkey, count(*) n, count(DISTINCT op) k, count(DISTINCT field) f FROM o GROUP BY 1) a USING (c_custkey)""")
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    components, ops = _customer_sides(spark, sf_dir)
    return R.component_summary(components, ops, ops, "c_custkey", "op", "field")


@query(f"""WITH o AS ({_OPS}) SELECT c.c_custkey, count(o.op) AS n_operations, count(DISTINCT o.op) AS n_kinds, count(DISTINCT f.field) AS n_fields
 FROM customer c LEFT JOIN o USING (c_custkey) LEFT JOIN o f USING (c_custkey) GROUP BY 1""")
def component_summary_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    components, ops = _customer_sides(spark, sf_dir)
    return R.component_summary(components, ops, ops, "c_custkey", "op", "field", exact=False)


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_components, count(*) AS n_operations, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag_set,
 string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS l_linestatus_set, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS l_linenumber_set
 FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) > 1""")
def field_usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shared_targets(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_linenumber >= 6 AND l_partkey IS NOT NULL)")
def unused_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are defined but never returned with a late line of an order; names of kinds are compared in lower case."""
    used = read(spark, sf_dir, "lineitem").where(F.lower("l_returnflag").isin("r", "a") & (F.col("l_linenumber") >= 6)).select(F.col("l_partkey").alias("p_partkey"))
    return R.never_used(read(spark, sf_dir, "part").select("p_partkey", "p_name"), used, "p_partkey")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_array_length('[' || json_extract_string(props, '$.k') || ']') AS INTEGER) AS n_items
 FROM events""")
def json_complexity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select("event_id", k.cast("int").alias("k"), F.json_array_length(F.concat(F.lit("["), k, F.lit("]"))).alias("n_items"))


@query("""SELECT user_id, count(*) AS n_steps, count(DISTINCT event_type) AS n_kinds, string_agg(event_type, '>' ORDER BY ts, event_id, event_type) AS steps FROM events GROUP BY user_id""")
def lifecycle_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lifecycle(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT 'customer' AS "table", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
 UNION ALL SELECT 'documents', count(*) FROM documents""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table, one labelled count each."""
    out = None
    for name in ("customer", "orders", "lineitem", "documents"):
        one = read(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(CASE WHEN event_type <> 'error' AND value > 10 THEN 100.0 ELSE 0.0 END), 4) AS success_pct, round(avg(value), 4) AS avg_value
 FROM events GROUP BY 1""")
def hourly_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.col("event_type") != "error") & (F.col("value") > 10)
    return R.success_rate(read(spark, sf_dir, "events"), good, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), value="value")


@query("""WITH d AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)
 SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 100.0 ELSE 0.0 END), 4) AS success_pct, round(avg(value), 4) AS avg_value FROM d GROUP BY 1""")
def api_usage_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.success_rate(R.since(read(spark, sf_dir, "events"), "ts", "24 hours"), F.col("value") > 50, F.col("event_type"), value="value")


@query("""SELECT count(*) AS n, round(avg(l_quantity), 4) AS mean, count(*) FILTER (l_quantity >= 45) AS from_45, count(*) FILTER (l_quantity >= 30 AND l_quantity < 45) AS from_30,
 count(*) FILTER (l_quantity < 30) AS rest FROM lineitem""")
def dashboard_match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.buckets(read(spark, sf_dir, "lineitem"), "l_quantity", 45, 30)


@query("""WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS name FROM lineitem UNION ALL SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_suppkey <> l_linenumber)
 SELECT name, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, name LIMIT 15""")
def top_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 names in most pairs; the limit is the report's."""
    return R.activity(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber", 15)


@query("""WITH u AS (SELECT l_partkey AS id, 'returned' AS kind FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 'large' FROM lineitem WHERE l_quantity > 45
 UNION ALL SELECT l_partkey, 'discounted' FROM lineitem WHERE l_discount > 0.05) SELECT id, count(*) AS n, count(DISTINCT kind) AS n_kinds FROM u GROUP BY id""")
def union_all_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of findings counted together; one scan, each row marked for every kind it has."""
    kinds = {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 45, "discounted": F.col("l_discount") > 0.05}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.explode(found).alias("kind")).groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("n_kinds"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5")
def heavy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(read(spark, sf_dir, "orders"), "o_custkey").where("n > 5")


@query("""SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS sample
 FROM orders GROUP BY 1, 2""")
def component_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their span and, where one row stands for all, the newest."""
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), newest.alias("sample"))


@query("""SELECT 'all' AS kind, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT o_orderstatus, count(DISTINCT o_custkey) FROM orders GROUP BY 1""")
def component_stats_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.groupingSets([[], ["o_orderstatus"]], "o_orderstatus").agg(F.count_distinct("o_custkey").alias("n"), F.grouping("o_orderstatus").alias("g")).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("o_orderstatus")).alias("kind"), "n")


@query("""WITH s AS (SELECT o_orderpriority, avg(o_totalprice) m, max(o_totalprice) x, min(o_totalprice) l FROM orders GROUP BY 1)
 SELECT o_orderpriority, round(m, 4) AS mean, x AS max, l AS min, count(*) FILTER (o_totalprice > m + (x - m) / 2) AS n_high FROM orders JOIN s USING (o_orderpriority) GROUP BY o_orderpriority, m, x, l""")
def complexity_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trends(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@query("""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""".replace("SELECT * FROM (", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (", 1))
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upsert by key leaves."""
    return R.latest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition of this engine: subtotals."""
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping_id().alias("level"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An addition of this engine: all subtotals."""
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_suppkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, l_returnflag) n FROM m)
 SELECT l_suppkey, l_returnflag AS usual, (SELECT count(DISTINCT x.l_partkey) FROM lineitem x WHERE x.l_suppkey = r.l_suppkey) AS n_targets FROM r WHERE n = 1""")
def merge_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging the findings of a component: the most frequent label (least on ties) and how many targets."""
    lines = read(spark, sf_dir, "lineitem")
    counts = lines.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("c"))
    usual = counts.groupBy("l_suppkey").agg(F.min_by("l_returnflag", F.struct(-F.col("c"), F.col("l_returnflag"))).alias("usual"))
    return usual.join(lines.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n_targets")), "l_suppkey")


@query("""WITH s AS (SELECT user_id, avg(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) AS m, count(DISTINCT event_type) AS k FROM events GROUP BY 1)
 SELECT user_id, round(m, 4) AS level, CASE WHEN m < 1.5 THEN 'low' WHEN m > 2.5 THEN 'high' ELSE 'medium' END AS rating, k AS n_kinds FROM s""")
def merge_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging ratings: the mean of their ranks, named again."""
    rank = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    out = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(rank).alias("m"), F.count_distinct("event_type").alias("n_kinds"))
    return out.select("user_id", F.round("m", 4).alias("level"), F.when(F.col("m") < 1.5, "low").when(F.col("m") > 2.5, "high").otherwise("medium").alias("rating"), "n_kinds")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS sample FROM events GROUP BY 1, 2)
 SELECT user_id, string_agg(event_type || '=' || n || '@' || sample, ';' ORDER BY event_type) AS usage FROM c GROUP BY 1""")
def program_field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level counts of each component as one value."""
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))
    one = F.concat(F.col("event_type"), F.lit("="), F.col("n"), F.lit("@"), F.col("sample"))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", one.alias("t")))), lambda x: x["t"]), ";").alias("usage"))
