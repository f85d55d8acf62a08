"""What the findings of round 3 were about: exact bounds, sums in order, plans without joins of made rows, texts dealt to many tasks."""

import time

from pyspark.sql import functions as F

from stratalith.functions import scoring
from stratalith.operators import lineage, ordered, program
from stratalith.plans import catalog


def test_journey_of_a_long_file_is_linear(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("f"), F.col("id").alias("o"), F.when(F.col("id") % 1000 < 500, "READ").otherwise("CREATE").alias("a"))
    start = time.monotonic()
    got = lineage.journey(rows, "f", "o", ["o"], F.col("a")).collect()[0]
    assert time.monotonic() - start < 60
    assert (got["n_steps"], got["first_program"], got["last_program"], got["journey"]) == (60_000, "0", "59999", ">".join(["reader", "creator"] * 60))


def test_variance_of_two_is_not_below_two(spark, tmp_path):
    """The running mean of these keys' remainders gives 1.9999999999999998; the variance is 2, which earns nothing."""
    rows = [(10 + k, 7 * k + x, "3-MEDIUM", "O") for k, x in enumerate([2, 6, 4, 2, 4, 5, 5])]
    spark.createDataFrame([(1, *r[1:]) for r in rows], "o_custkey long, o_orderkey long, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert catalog.QUERIES["quality_score"](spark, str(tmp_path)).first()["quality"] == 5.0
    got = spark.createDataFrame([(x,) for x in [2, 6, 4, 2, 4, 5, 5]], "x long").repartition(3).agg(scoring.variance(F.col("x")).alias("v")).first()["v"]
    assert got == 2.0


def test_token_estimate_sums_from_left_to_right(spark):
    """Prose of 5,376 characters whose sum is an integer in one order and just below it in the other."""
    n, words, marks, ends = 5376, 1068, 2069, 30
    parts = ["!" for _ in range(words)]
    parts[0] = "=="
    left, letters = marks - words - 1, n - marks - 1500
    parts[1], parts[2] = parts[1] + "!" * left, parts[2] + "a" * letters
    gaps = ["\n"] * ends + [" "] * (words - 1 - ends)
    text = "".join(p + g for p, g in zip(parts, [*gaps, " " * (1500 - words + 1)], strict=True))
    assert (len(text), len(text.split()), text.count("\n")) == (n, words, ends)
    want = int(n / 4.2 + marks * 0.3 + words * 0.1 + ends * 0.5 + 1 * 0.5)
    assert want != int(n / 4.2 + (((marks * 0.3 + words * 0.1) + ends * 0.5) + 0.5))
    assert spark.createDataFrame([(text,)], "t string").select(scoring.estimated_tokens(F.col("t"))).first()[0] == want


def test_layouts_and_sections_are_joined_with_nothing(spark, sf_dir):
    """Spark would broadcast one side of such a join by the size of the part table's file, and the driver would hold all made rows."""
    for name in ("layout_tree", "source_sections", "copybook_fields", "token_chunks"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan, name


def test_sources_of_a_small_table_go_to_many_tasks(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("embedded_commands", "layout_tree", "source_sections", "field_references_by_operation", "cobol_calls"):
        df = catalog.QUERIES[name](spark, sf_dir)
        assert df.rdd.getNumPartitions() >= parts and df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() == parts, name


def test_parents_keep_columns_and_skip(spark):
    rows = [("p", 1, 1, "A", "x"), ("p", 2, 5, "B", "y"), ("p", 3, 88, "C", "z"), ("p", 4, 10, "D", None), ("p", 5, 5, "E", "w")]
    items = spark.createDataFrame(rows, "k string, at int, level int, name string, more string")
    got = ordered.parents(items, ["k"], "at", "level", "name", F.col("level") == 88).orderBy("at").collect()
    assert [tuple(r) for r in got] == [(*r, p) for r, p in zip(rows, [None, "A", None, "B", "A"], strict=True)]


def test_a_source_is_tidied_once(spark):
    """Each pass over the text stands once in the plan: what uses its result does not work it out again."""
    plan = spark.range(1).select(program.tidy(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("regexp_replace(") <= 5
