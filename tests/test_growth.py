"""What was found to grow faster than the input: statements cut in their row, texts made behind the shuffle."""

from pyspark.sql import functions as F

from stratalith.operators import copybooks, program, programs, relations
from stratalith.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_statements_need_no_sort_and_no_shuffle(spark):
    got = plan(program.statements(spark.range(9).select("id", F.lit("PROCEDURE DIVISION.").alias("t")), "id", "t"))
    assert not any(x in got for x in ("Window", "Sort", "Exchange", "Aggregate")) and "Generate" in got


def test_statements_of_a_long_source_are_linear(spark):
    text = "PROCEDURE DIVISION.\n" + "".join(f"S-{i} SECTION.\nP-{i}.\n IF A > {i} MOVE A TO B\n  ELSE EXEC SQL DELETE FROM T. END-EXEC END-IF CALL 'X'.\n" for i in range(20_000))
    rows = program.statements(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t")
    last = rows.orderBy(F.desc("n")).first()
    assert (rows.count(), last["line"], last["section"], last["paragraph"], last["place"], last["verb"], last["conditional"]) == (180_001, 80_001, "S-19999", "P-19999", 20_000, "CALL", False)


def test_statements_of_odd_form(spark):
    text = "A-1.\nPROCEDURE DIVISION. MOVE A TO B\n. FOO BAR\n IF X\nS-1 SECTION 50. MOVE GONE TO X.\n\nADD.\n EXEC SQL SELECT A.\n DELETE END-EXEC. IF(Y) GO TO P-9. EXIT."
    rows = program.statements(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("n").collect()
    assert [(r["line"], r["section"], r["paragraph"], r["place"], r["sentence"], r["verb"], r["body"], r["conditional"]) for r in rows] == [
        (2, None, None, 0, 1, "PROCEDURE", "DIVISION", False), (2, None, None, 0, 2, "MOVE", "A TO B", False), (3, None, None, 0, 3, "FOO", "BAR", False), (4, None, None, 0, 3, "IF", "X", False),
        (5, "S-1", None, 0, 3, "SECTION", "S-1", True), (7, "S-1", "ADD", 1, 4, "LABEL", "ADD", False), (8, "S-1", "ADD", 1, 5, "EXEC", "SQL SELECT A . DELETE", False), (9, "S-1", "ADD", 1, 5, "END-EXEC", "", False),
        (9, "S-1", "ADD", 1, 6, "IF(Y)", "", False), (9, "S-1", "ADD", 1, 6, "GO", "TO P-9", False), (9, "S-1", "ADD", 1, 7, "EXIT", "", False)]


def test_sources_of_orders_are_made_behind_the_shuffle(spark, sf_dir):
    """What is shuffled are numbers; AQE joins no partitions of them, as texts are many times as large."""
    for name in ("mq_sequences", "mq_message_flows"):
        df = catalog.QUERIES[name](spark, sf_dir)
        lines = plan(df).splitlines()
        assert sum("Exchange" in x for x in lines) == 1 and any("REPARTITION_BY_NUM" in x for x in lines), name


def test_control_flow_shuffles_numbers_once(spark, sf_dir):
    """Sources that are dealt by their key are followed where they are; nothing is joined or written in between."""
    df = catalog.QUERIES["control_flow_paths"](spark, sf_dir)
    got = plan(df)
    assert sum("Exchange" in x for x in got.splitlines()) == 1 and "Join" not in got and "Scan ExistingRDD" not in got


def test_paragraph_before_section_of_one_name(spark):
    text = "PROCEDURE DIVISION.\nX SECTION.\nA.\n PERFORM B THRU X PERFORM NONE PERFORM X.\nB.\n GO TO X.\nC.\n PERFORM C THRU NONE.\nB.\n EXIT.\nA SECTION.\nX.\n GO TO B, NONE DEPENDING ON I.\nD.\n STOP RUN."
    st = program.statements(spark.createDataFrame([("p", text)], "k string, t string"), "k", "t")
    got = [(r["path_id"], r["entry_point"], r["last_point"], r["paragraphs"], r["exit_points"], r["called_paragraphs"], r["loops"]) for r in program.control_flow(st, "k").orderBy("path_id").collect()]
    assert got == [("PATH_1", "B", "X", ["B", "X"], ["X"], [], True), ("PATH_2", "C", "C", ["C"], ["C"], ["C"], False), ("PATH_3", "X", "X", ["B", "X"], ["X"], [], True)]


def test_relations_of_a_report_are_found_once(spark, sf_dir):
    got = plan(catalog.QUERIES["program_reports"](spark, sf_dir))
    assert got.count("[l_orderkey#") and sum("Scan parquet" in x and "l_orderkey" in x for x in got.splitlines()) == 1 and "REPARTITION_BY_NUM" in got


def test_report_of_a_program_that_needs_nothing(spark):
    rows = [("p", "sql", "T", 0.8), ("p", "field", "F", 0.9), ("q", "call", "x", 0.8), ("q", "call", "X", 0.8), ("q", "copybook", "X", 0.9)]
    df = spark.createDataFrame(rows, "k string, category string, target string, confidence double")
    some = spark.createDataFrame([("x",)], "name string")
    got = {r["k"]: r for r in programs.program_report(df, "k", some, some.where("false")).collect()}
    assert (got["p"]["n_sql"], got["p"]["n_field"], got["p"]["called_programs"], got["p"]["has_missing"], got["p"]["confidence"]) == (1, 1, [], False, 0.85)
    assert (got["q"]["n_call"], got["q"]["called_programs"], got["q"]["missing_programs"], got["q"]["required_copybooks"], got["q"]["missing_copybooks"]) == (2, ["X"], ["X"], ["X"], [])


def test_targets_are_dealt_to_many_tasks(spark):
    """Pairs are made in tasks that Spark does not join by the small size of the uses."""
    uses = spark.range(3000).select((F.col("id") % 300).alias("c"), (F.col("id") * 7 % 100).alias("t"))
    assert plan(relations.sharing(uses, "c", "t")).count("REPARTITION_BY_NUM") >= 1


def test_layouts_go_to_many_tasks(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("record_fields", "level_violations"):
        assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= parts, name


def test_a_replacement_list_is_looked_through_once(spark):
    """The patterns stand once in the plan, and are made only of what the text has."""
    df = spark.range(1).select(copybooks.replaced(F.lit("A :T: B"), copybooks.pairs(F.lit("REPLACING ==:T:== BY ==X== A  BY C NONE BY D"))).alias("t"))
    assert df._jdf.queryExecution().analyzed().toString().count("(?i:") == 1 and df.first()["t"] == "C X B"
