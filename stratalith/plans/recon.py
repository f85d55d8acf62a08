"""Reconciliation and data-quality queries over orders, lineitem and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recon as R
from .catalog import query, read

_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
_BASE = f"l AS (SELECT {', '.join(_COLS)} FROM orders)"
_RIGHT = """k AS (SELECT o_orderkey AS ok, row_number() OVER (ORDER BY o_orderkey) AS pos FROM (SELECT DISTINCT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)),
 r AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN pos <= greatest(1, least((SELECT count(*) FROM orders) // 20, 10)) THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM l LEFT JOIN k ON o_orderkey = ok)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = read(spark, sf_dir, "orders").select(*_COLS)
    return left, R.perturbed(left, "o_totalprice", "o_orderkey")


@query(f"""WITH {_BASE}, {_RIGHT}, m AS (SELECT count(*) AS n FROM (SELECT * FROM l INTERSECT ALL SELECT * FROM r)), c AS (SELECT (SELECT count(*) FROM l) AS a, (SELECT count(*) FROM r) AS b, n FROM m)
 SELECT a AS left_rows, b AS right_rows, n AS matching, a - n AS left_only, b - n AS right_only, round(n * 100.0 / greatest(a, b), 4)::DOUBLE AS match_pct FROM c""")
def recon_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.compare(*_sides(spark, sf_dir))


@query(f"WITH {_BASE}, {_RIGHT} SELECT * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) ORDER BY o_orderkey LIMIT 3")
def recon_left_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of the left side alone (a sample is the feature)."""
    left, right = _sides(spark, sf_dir)
    return R.only_in(left, right, ["o_orderkey"])


@query(f"WITH {_BASE}, {_RIGHT} SELECT * FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) ORDER BY o_orderkey LIMIT 3")
def recon_right_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return R.only_in(right, left, ["o_orderkey"])


@query(f"WITH {_BASE}, {_RIGHT} SELECT * FROM (SELECT * FROM r INTERSECT ALL SELECT * FROM l) ORDER BY o_orderkey LIMIT 3")
def recon_matching_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return R.in_both(left, right, ["o_orderkey"])


@query("""SELECT * FROM (VALUES ('c_acctbal', 'double', NULL, 'left_only'), ('c_custkey', 'bigint', 'bigint', 'same'), ('c_mktsegment', 'string', NULL, 'left_only'), ('c_name', 'string', NULL, 'left_only'),
 ('c_nationkey', 'int', 'bigint', 'type_differs'), ('s_name', NULL, 'string', 'right_only')) t("column", left_kind, right_kind, state)""")
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer")
    right = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name", F.col("s_nationkey").cast("bigint").alias("c_nationkey"))
    return R.schema_diff(left, right)


@query("SELECT 2::BIGINT AS common, 1::BIGINT AS type_differs, 0.4::DOUBLE AS similarity")
def schema_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = read(spark, sf_dir, "customer")
    return R.schema_similarity(left, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name", F.col("s_nationkey").cast("bigint").alias("c_nationkey")))


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.expr("nullif(o_custkey % 10, 3)").alias("digit"), "o_orderpriority")


_HOLES = "h AS (SELECT nullif(o_orderstatus, 'P') AS status, nullif(o_custkey % 10, 3) AS digit, o_orderpriority FROM orders)"


@query(f"""WITH {_HOLES}, p AS (SELECT (sum((status IS NULL)::INT) + sum((digit IS NULL)::INT) + sum((o_orderpriority IS NULL)::INT)) * 100.0::DOUBLE / (count(*) * 3) AS x FROM h)
 SELECT 'null_check' AS rule, round(x, 4) AS pct, round(greatest(0.0, 100 - x), 4) AS score, CASE WHEN x < 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM p""")
def dq_null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.null_check(_holes(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(f"""WITH {_HOLES}, g AS (SELECT count(*) AS n FROM h GROUP BY status, digit, o_orderpriority), p AS (SELECT (sum(n) - count(*)) * 100.0::DOUBLE / sum(n) AS x FROM g)
 SELECT 'duplicate_check' AS rule, round(x, 4) AS pct, round(greatest(0.0, 100 - 10 * x), 4) AS score, CASE WHEN x < 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM p""")
def dq_duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_check(_holes(spark, sf_dir)).withColumn("score", F.round("score", 4))


_OUT = """v AS (SELECT 'l_quantity' AS "column", l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
 q AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1),
 o AS (SELECT "column", q1, q3, count(*) AS n, count(*) FILTER (q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS n_outliers FROM v JOIN q USING ("column") GROUP BY 1, 2, 3)"""


@query(f"""WITH {_OUT} SELECT "column", round(q1, 4) AS q1, round(q3, 4) AS q3, n, n_outliers, round(n_outliers * 100.0::DOUBLE / n, 4) AS pct FROM o""")
def dq_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outliers(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query(f"""WITH {_HOLES}, g AS (SELECT count(*) AS n FROM h GROUP BY status, digit, o_orderpriority), d AS (SELECT greatest(0.0, 100 - 10 * ((sum(n) - count(*)) * 100.0::DOUBLE / sum(n))) AS s FROM g),
 n AS (SELECT greatest(0.0, 100 - (sum((status IS NULL)::INT) + sum((digit IS NULL)::INT)) * 100.0::DOUBLE / (count(*) * 3)) AS s FROM h)
 SELECT round((round(n.s, 4) * 1.0 + round(d.s, 4) * 0.8 + 100.0 * 0.9 + 100.0 * 0.6 + 0.0 * 1.0)::DOUBLE / 4.3, 2)::DOUBLE AS quality_score FROM n, d""")
def dq_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"null_check": {}, "duplicate_check": {}, "data_type_check": {}, "range_check": {"columns": ["digit"]}, "unheard_of": {}}
    return R.weighted_score(R.apply_rules(_holes(spark, sf_dir), rules))


@query(f"""WITH {_HOLES}, g AS (SELECT count(*) AS n FROM h GROUP BY status, digit, o_orderpriority)
 SELECT round(0.4 * (1 - (SELECT (sum((status IS NULL)::INT) + sum((digit IS NULL)::INT))::DOUBLE / (count(*) * 3) FROM h)) + 0.3 * (1 - (SELECT (sum(n) - count(*))::DOUBLE / sum(n) FROM g))
 + 0.3 * (SELECT (count(DISTINCT status)::DOUBLE / count(status) + count(DISTINCT o_orderpriority)::DOUBLE / count(o_orderpriority)) / 2 FROM h), 4) AS quality""")
def csv_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table_quality(_holes(spark, sf_dir), ["status", "o_orderpriority"])


@query("""WITH e AS (SELECT o_custkey AS a, o_orderkey % 7 AS b, o_orderdate AS ts, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS differences FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts DESC, id DESC) AS n FROM e)
 SELECT a, b, id, differences, CASE WHEN differences = 0 THEN 'none' ELSE 'reconcile' END AS action FROM r WHERE n = 1""")
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest comparison of every pair and what follows from it."""
    from ..operators.reports import latest

    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 7).alias("b"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"),
                                               F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("differences"))
    return latest(log, ["a", "b"], [F.desc("ts"), F.desc("id")]).select("a", "b", "id", "differences", F.when(F.col("differences") == 0, "none").otherwise("reconcile").alias("action"))
