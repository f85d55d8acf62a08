"""Program kinds, relations, lifecycles and summaries on odd rows."""

import datetime as dt

from pyspark.sql import functions as F

from stratalith.operators import extract, programs, summaries
from stratalith.operators.program import statements
from stratalith.operators.relations import filled


def test_fixed_form_is_extracted(spark):
    text = "000100 IDENTIFICATION DIVISION.                                         X0000001\n000200 PROGRAM-ID. ABC.\n000300 01  REC-A.\n000400     05 FLD-A PIC X.\n000500     COPY BOOK-A.\n000600*    COPY GONE.\n000700 PROCEDURE DIVISION.\n000800     EXEC SQL SELECT A\n000900       FROM T END-EXEC\n001000     EXEC SQL DELETE FROM U END-EXEC."
    found = extract.facts(spark.createDataFrame([(1, text), (2, None)], "k long, t string"), "k", "t", extract.COBOL).collect()
    got = {(r["kind"], r["line"], r["a"]) for r in found}
    assert {("program_id", 2, "ABC"), ("data_item", 3, "01"), ("data_item", 4, "05"), ("copy", 5, "BOOK-A"), ("sql", 8, "SELECT"), ("sql", 10, "DELETE")} <= got and not any(r["a"] == "GONE" for r in found)


def test_relations_of_a_line(spark):
    text = "  EXEC CICS LINK FILE('A') PROGRAM('B')\n  exec cics xctl program(\"c\")\n COPY X-1. CALL 'P'\n* CALL 'NO'\n CALL VAR\n EXEC SQL INSERT INTO T\n 01 F-1 PIC X.\n EXEC CICS RETURN\n CALL 'P'"
    rows = programs.line_relations(spark.createDataFrame([(1, 10, text), (2, 1, None)], "k long, f int, t string"), "k", "t", "f").collect()
    got = sorted((r["line"], r["category"], r["type"], r["target"], r["confidence"]) for r in rows)
    assert got == [(10, "cics_file", "CICS_WRITE", "A", 0.7), (11, "cics_program", "CICS_XCTL", "C", 0.8), (12, "copybook", "COPY", "X-1", 0.9), (15, "sql", "SQL_INSERT", "UNKNOWN_TABLE", 0.8), (16, "field", "FIELD_DEFINITION", "F-1", 0.9), (18, "call", "CALL", "P", 0.8)]
    df = spark.createDataFrame([(1, "call", "CALL", "P", 3, 0.5), (1, "call", "CALL", "P", 3, 0.8), (1, "copybook", "COPY", "B", 4, 0.9)], "k long, category string, type string, target string, line int, confidence double")
    merged = programs.merged_sections(df, "k")
    assert sorted((r["target"], r["confidence"]) for r in merged.collect()) == [("B", 0.9), ("P", 0.8)]
    r = programs.program_report(merged, "k", spark.createDataFrame([("b",)], "name string"), spark.createDataFrame([], "name string")).first()
    assert (r["n_call"], r["n_copybook"], r["required_copybooks"], r["missing_copybooks"], r["missing_programs"], r["has_missing"]) == (1, 1, ["B"], [], ["P"], True)


def test_kinds_and_metadata_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200000), (4, "PROCEDURE DIVISION. EXEC SQL CREATE PROCEDURE P")], "k long, t string")
    rows = {r["k"]: r for r in df.select("k", *(c.alias(n) for n, c in programs.kinds(F.col("t")).items()), *(c.alias(n) for n, c in programs.metadata(F.col("t")).items())).collect()}
    assert all(not any(v for k, v in rows[i].asDict().items() if k != "k") for i in (1, 2, 3)) and rows[4]["stored_procedure"] and rows[4]["db2_operations"] == ["CREATE"]


def test_procedures_and_result_sets(spark):
    text = "PROCEDURE DIVISION.\n EXEC SQL CALL S.P END-EXEC\n EXEC SQL ASSOCIATE LOCATOR (:L) END-EXEC EXEC SQL CALL Q(:A, 5)\n END-EXEC"
    rows = programs.procedure_calls(statements(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t"), "k").orderBy("line", "kind").collect()
    assert [(r["line"], r["kind"], r["name"], r["parameters"]) for r in rows] == [(2, "call", "S.P", []), (3, "call", "Q", ["A", "5"]), (3, "locators", None, ["L"])]


def test_field_facts_and_findings(spark):
    t = dt.datetime(2024, 1, 1)
    uses = spark.createDataFrame([("F", "P", "READ", t), ("F", "Q", "WRITE", None), ("F", "P", "READ", t), (None, "P", "READ", t)], "f string, p string, o string, at timestamp_ntz")
    r = summaries.field_facts(uses, "f", "p", "o", "at", 2).collect()
    assert [(x["field"], x["uses"], x["programs"], x["operations"], x["recent"]) for x in r] == [("F", 3, ["P", "Q"], ["READ", "WRITE"], ["P:READ", "P:READ"])]
    names = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "name string")
    out = summaries.findings(names, spark.createDataFrame([("A", "B"), ("A", "B"), ("X", "A")], "calling string, called string"), spark.createDataFrame([("B", "P"), ("B", "P")], "file string, program string"))
    assert {r["name"]: r["summary"] for r in out.collect()} == {
        "A": "Program Integration: 2 outbound calls, 1 inbound calls\nLineage Impact: 1 upstream dependencies, 1 downstream impacts",
        "B": "Program Integration: 0 outbound calls, 2 inbound calls\nData Flow: Accessed by 1 programs\nLineage Impact: 1 upstream dependencies, 0 downstream impacts", "C": summaries.GENERAL}


def test_failures_are_rows(spark):
    rows = spark.createDataFrame([(i, i) for i in range(6)] + [(None, 3)], "k long, v long")
    found = summaries.attempted(rows, "k", lambda r: None if r["v"] == 1 else 6 // r["v"])
    got = sorted((str(r["k"]), r["status"], r["result"], r["error"]) for r in found.collect())
    assert got[0] == ("0", "error", None, "ZeroDivisionError: integer division or modulo by zero") or got[0][3].startswith("ZeroDivisionError")
    assert got[1] == ("1", "error", None, "no result") and got[2:] == [("2", "success", "3", None), ("3", "success", "2", None), ("4", "success", "1", None), ("5", "success", "1", None), ("None", "success", "2", None)]
    r = summaries.batch_report(found).first()
    assert (r["n"], r["succeeded"], r["failed"], r["success_rate"], r["common_error"]) == (7, 5, 2, 71.43, "no result")
    r = summaries.batch_report(found.limit(0)).first()
    assert (r["n"], r["failed"], r["success_rate"], r["common_error"]) == (0, 0, 0.0, None)
    slow = summaries.attempted(rows.limit(1), "k", lambda r: __import__("time").sleep(0.2) or 1, 0.05).first()
    assert slow["status"] == "error" and slow["error"] == "timeout"


def test_chunks_of_layouts(spark):
    lines = ["01 REC."] + [f"  05 F{i} PIC X({'9' * 40})." for i in range(10)] + ["* " + "c" * 500, "  05 LAST PIC X."]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k long, i int, t string")
    rows = summaries.layout_chunks(df, "k", "i", "t", 130, 2).orderBy("chunk").collect()
    assert rows[0]["first"] == 0 and rows[-1]["last"] == len(lines) - 1 and all(a["last"] + 1 == b["first"] for a, b in zip(rows, rows[1:]))
    assert all(r["n_fields"] >= 2 for r in rows[:-1]) and sum(r["n_chars"] for r in rows) == sum(len(x) + 1 for x in lines)


def test_averages_and_defaults(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", 1.0, t), ("a", 3.0, t + dt.timedelta(hours=5)), ("b", 9.0, t - dt.timedelta(hours=9)), ("a", float("nan"), t), ("a", None, t)], "n string, v double, ts timestamp_ntz")
    assert {r["n_"]: r["average"] for r in summaries.averages(df.withColumnRenamed("n", "n_"), "n_", "v", "ts").collect()} == {"a": 2.0, "b": 0.0}
    assert filled(df, {"V": None, "gone": 5, "none": None}).limit(1).collect()[0].asDict() == {"V": 1.0, "gone": 5, "none": None}
