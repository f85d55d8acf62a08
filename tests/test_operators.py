"""Operators on small inputs: nulls, ties, empty tables, names with marks."""

import zipfile

import pytest
from pyspark.sql import functions as F

from stratalith.functions import names as N
from stratalith.functions import scoring as S
from stratalith.operators import chunks, extract, lineage, monitor, ordered, recon, relations, reports, search
from stratalith.sources import files


def one(df):
    return [tuple(r) for r in df.collect()]


def test_compare_counts_multisets_and_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    r = recon.compare(left, right).first()
    assert (r["matching"], r["left_only"], r["right_only"], r["match_pct"]) == (2, 1, 1, pytest.approx(66.6667))
    empty = recon.compare(left.limit(0), right.limit(0)).first()
    assert (empty["matching"], empty["match_pct"]) == (0, 0.0)
    with pytest.raises(ValueError):
        recon.compare(left, right.toDF("x", "y"))


def test_rules(spark):
    df = spark.createDataFrame([(1, "1"), (1, "1"), (None, "x"), (4, "2.5")], "a int, b string")
    got = {r["rule"]: r for r in recon.apply_rules(df, {"null_check": {}, "duplicate_check": {}, "data_type_check": {}, "nothing": {}}).collect()}
    assert got["null_check"]["pct"] == 12.5 and got["null_check"]["status"] == "FAIL"
    assert got["duplicate_check"]["pct"] == 25.0 and got["duplicate_check"]["score"] == 0.0
    assert got["data_type_check"]["score"] == 80.0
    assert got["nothing"]["status"] == "SKIPPED"
    assert recon.table_quality(df.limit(0), ["b"]).first()["quality"] == 0.0


def test_sample_csv_quality(spark):
    rows = [(1, "John Smith", 1.5, "CHECKING"), (2, "Jane Doe", 2.5, "SAVINGS"), (3, "Bob Johnson", 3.5, "CHECKING"), (4, "Al Bo", 4.5, "SAVINGS")]
    df = spark.createDataFrame(rows, "id int, name string, balance double, kind string")
    assert recon.table_quality(df, ["name", "kind"]).first()["quality"] == pytest.approx(0.925)
    assert {r["column"]: r["sql_type"] for r in files.profile(df).collect()} == {"id": "INTEGER", "name": "VARCHAR(13)", "balance": "REAL", "kind": "VARCHAR(9)"}


def test_perturbed_changes_a_twentieth(spark):
    df = spark.range(60).withColumn("v", F.lit(1.0))
    assert one(recon.perturbed(df, "v", "id").where("v = 2").select("id").orderBy("id")) == [(0,), (1,), (2,)]


def test_anti_join_with_null_key(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "k int"), spark.createDataFrame([(None,), (2,)], "k int")
    assert sorted(one(relations.lacking(a, b, "k")), key=str) == [(1,), (None,)]


def test_contained_names_both_ways_and_short_ones(spark):
    a = spark.createDataFrame([("ORDER-FILE",), ("CUST",), ("X",)], "a string")
    b = spark.createDataFrame([("order",), ("CUSTOMER",), ("ABXY",), ("zz",)], "b string")
    assert sorted(one(relations.contained(a, "a", b, "b"))) == [("CUST", "CUSTOMER"), ("ORDER-FILE", "order"), ("X", "ABXY")]


def test_islands_and_parents(spark):
    df = spark.createDataFrame([("f", p) for p in (1, 5, 300, 310, 600)], "k string, at int")
    assert [r["island"] for r in ordered.by_gap(df, ["k"], "at", 200).orderBy("at").collect()] == [0, 0, 1, 1, 2]
    items = spark.createDataFrame([("p", i, lv, n) for i, (lv, n) in enumerate([(1, "A"), (5, "B"), (10, "C"), (10, "D"), (5, "E"), (1, "F")])], "k string, at int, level int, name string")
    assert [r["parent"] for r in ordered.parents(items, ["k"], "at", "level", "name").orderBy("at").collect()] == [None, "A", "B", "B", "A", None]


def test_depth_never_below_zero(spark):
    assert spark.range(1).select(ordered.deepest(F.array(*[F.lit(x) for x in (-1, 1, 1, -1, 1, 1)]))).first()[0] == 3


def test_unique_names(spark):
    df = spark.createDataFrame([(i, "FILLER") for i in range(3)], "i int, n string").withColumn("k", F.lit(1))
    assert [r["unique_name"] for r in ordered.numbered_names(df, ["k"], "n", ["i"]).orderBy("i").collect()] == ["FILLER", "FILLER_1", "FILLER_2"]


def test_scores(spark):
    df = spark.createDataFrame([("IF A\n  PERFORM B\nEND-IF",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(S.complexity(F.col("t"))).collect()]
    assert got[0] == 1 + 3 + 1.5 and got[2] == 1.0
    assert df.select(S.complexity_strict(F.col("t"))).first()[0] == 1 + 2 + 1.0
    assert spark.range(1).select(S.domain(F.lit("CUST-ACCT-BAL"))).first()[0] == "financial"
    assert spark.range(1).select(S.intent(F.lit("compare a versus b, find it"))).first()[0] == "comparison"
    assert spark.range(1).select(S.intent(F.lit("hello"))).first()[0] == "general"
    assert spark.range(1).select(S.system_risk(F.lit(0.5), F.lit(0.5), F.lit(0.5))).first()[0] == "HIGH"


@pytest.mark.parametrize(("pic", "kind"), [("9(8)", "INTEGER"), ("S9(7)V99", "DECIMAL(9,2)"), ("X(30)", "VARCHAR(30)"), ("9(10)V99", "DECIMAL(12,2)"), ("9(12)V99", "DECIMAL(14,2)")])
def test_pictures(spark, pic, kind):
    assert spark.range(1).select(N.pic_type(F.lit(pic))).first()[0] == kind


def test_names(spark):
    row = spark.range(1).select(N.clean_column(F.lit("9 a--b!")), N.clean_table(F.lit("My File.csv")), N.clean_component(F.lit("/x/tmpabcd1234_PROG.cbl")), N.valid_field(F.lit("MOVE")), N.valid_file(F.lit("CUST-FILE"))).first()
    assert tuple(row) == ("col_9_a_b", "my_file", "PROG", False, True)


def test_extraction_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", "")], "p string, t string")
    for rules in extract.LANGUAGES.values():
        assert extract.facts(df, "p", "t", rules).count() == 0


def test_sample_program(spark):
    text = ("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. TEST-PROGRAM.\n       DATA DIVISION.\n       01  CUSTOMER-RECORD.\n           05  CUSTOMER-ID     PIC 9(8).\n           05  CUSTOMER-NAME   PIC X(30).\n"
            "           05  ACCOUNT-BALANCE PIC 9(10)V99.\n       PROCEDURE DIVISION.\n       MAIN-PROCESSING.\n           OPEN INPUT CUSTOMER-FILE\n           PERFORM READ-RECORDS UNTIL DONE\n           STOP RUN.\n       READ-RECORDS.\n           READ CUSTOMER-FILE.\n")
    found = extract.facts(spark.createDataFrame([("T", text)], "p string, t string"), "p", "t", extract.COBOL)
    items = {r["name"]: (r["sql_type"], r["parent"]) for r in extract.data_items(found, "p").collect()}
    assert items == {"CUSTOMER-RECORD": (None, None), "CUSTOMER-ID": ("INTEGER", "CUSTOMER-RECORD"), "CUSTOMER-NAME": ("VARCHAR(30)", "CUSTOMER-RECORD"), "ACCOUNT-BALANCE": ("DECIMAL(12,2)", "CUSTOMER-RECORD")}
    assert extract.unreachable(found, "p").count() == 0
    assert extract.violations(spark.createDataFrame([("T", text)], "p string, t string"), "p", "t", "cobol").count() == 0


def test_reach_ends_in_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    got = lineage.within(e, spark.createDataFrame([(1,)], "start int"), "a", "b", 10)
    assert sorted((r["node"], r["hops"]) for r in got.collect()) == [(2, 1), (3, 2), (4, 3)]
    chain = spark.range(40).selectExpr("cast(id as int) a", "cast(id + 1 as int) b")
    assert lineage.within(chain, spark.createDataFrame([(0,)], "start int"), "a", "b").count() == 40


def test_top_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    got = search.top_k(rows, rows.where("vec_id = 1"), 2, leave_self=True)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(1, 3, 1.0, 1), (1, 2, 0.0, 2)]
    assert search.top_k(rows.limit(0), rows, 2).count() == 0 and search.top_k(rows, rows.limit(0), 2).count() == 0


def test_packed_lines(spark):
    df = spark.createDataFrame([(1, "aa\nbb\ncccccc\nd")], "k int, t string")
    assert [(r["chunk"], r["text"]) for r in chunks.packed_lines(df, "k", "t", 4).orderBy("chunk").collect()] == [(0, "aa\nbb"), (1, "cccccc"), (2, "d")]


def test_alerts_and_status(spark):
    m = spark.createDataFrame([("cpu", 95.0), ("cpu", 10.0), ("mem", None)], "metric string, v double")
    a = monitor.alerts(m, spark.createDataFrame([("cpu", 70.0, 90.0), ("mem", 1.0, 2.0)], "metric string, warning double, critical double"), "metric", "v")
    assert one(a.select("metric", "severity")) == [("cpu", "critical")]
    assert one(monitor.overall(a)) == [("critical", 1)]


def test_reports_on_nothing(spark):
    df = spark.createDataFrame([], "t string, c string, k string")
    assert reports.shared_targets(df, "t", "c", "k").count() == 0


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.cbl", "IDENTIFICATION DIVISION.")
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = {r["archive"].rpartition("/")[2]: (r["member"], r["error"] is None) for r in files.archive_members(spark, str(tmp_path), "*.zip").collect()}
    assert got == {"a.zip": ("x.cbl", True), "b.zip": (None, False)}
    src = tmp_path / "src"
    src.mkdir()
    (src / "p.cbl").write_text("       IDENTIFICATION DIVISION.\n")
    (src / "e.cbl").write_bytes("IDENTIFICATION DIVISION. IS THE HEAD".encode("cp037"))
    (src / "w.txt").write_bytes("caf\xe9".encode("cp1252"))
    rows = {r["name"]: (r["kind"], r["text"]) for r in files.ingest(spark, str(src)).collect()}
    assert rows["p.cbl"][0] == "cobol" and rows["e.cbl"] == ("cobol", "IDENTIFICATION DIVISION. IS THE HEAD") and rows["w.txt"] == ("unknown", "café")
    assert files.ingest(spark, str(src), known=files.ingest(spark, str(src)).select("file_hash")).count() == 0
    (tmp_path / "d.csv").write_text("Cust Id|Na-me\n1|a\n2|b\n")
    df = files.read_csv(spark, str(tmp_path / "d.csv"))
    assert df.columns == ["Cust_Id", "Na_me"] and df.count() == 2
    with pytest.raises(ValueError):
        files.restricted(df, ["nothing"])


def test_upsert_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]):
        files.save_latest(spark.createDataFrame(rows, "k int, n int, v string"), path, ["k"], [F.desc("n")])
    assert sorted(one(spark.read.parquet(path))) == [(1, 2, "c"), (2, 1, "b")]


def test_a_broken_swap_is_undone(spark, tmp_path):
    path = tmp_path / "t"
    df = spark.createDataFrame([(1, 1, "a")], "k int, n int, v string")
    files.save_latest(df, str(path), ["k"], [F.desc("n")])
    path.rename(tmp_path / "t.old")  # as if the driver had died between the two moves
    files.save_latest(spark.createDataFrame([(2, 1, "b")], df.schema), str(path), ["k"], [F.desc("n")])
    assert sorted(one(spark.read.parquet(str(path)))) == [(1, 1, "a"), (2, 1, "b")]
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_retention_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(n) AS ts, n FROM (SELECT explode(sequence(0, 9)) AS n)").write.parquet(path)
    assert files.save_without_old(spark.read.parquet(path), path, "ts", 3) == 7
    assert sorted(one(spark.read.parquet(path).select("n"))) == [(7,), (8,), (9,)]


def test_tables_from_layouts(spark, tmp_path):
    path, catalogue = str(tmp_path / "t"), str(tmp_path / "schemas")
    columns = spark.createDataFrame([(0, "Cust Id", "INTEGER"), (1, "cust-id", "VARCHAR(5)"), (2, "SUM", "DECIMAL(9,2)")], "at int, column string, sql_type string")
    files.create_table(spark, path, columns)
    files.append(spark.createDataFrame([(1, "x", 2)], "a int, b string, c int").selectExpr("a as `Cust_Id`", "b as `cust_id_1`", "cast(c as decimal(9,2)) as SUM"), path)
    assert spark.read.parquet(path).dtypes == [("Cust_Id", "int"), ("cust_id_1", "string"), ("SUM", "decimal(9,2)")] and spark.read.parquet(path).count() == 1
    for version in (1, 2):
        files.save_schema(spark, catalogue, "t", columns, version)
    assert one(spark.read.parquet(catalogue).groupBy("version").count()) == [(2, 3)]


@pytest.mark.parametrize(("data", "text"), [("cafe".encode("cp037") + "   ".encode("cp037"), "cafe   "), ("naïve ß".encode(), "naïve ß"), ("naïve".encode("cp1252"), "naïve"), (b"", ""), ("abc".encode("utf-16"), "abc"), (b"\xef\xbb\xbfhead", "head")])
def test_codings(data, text):
    assert files.decode(data) == text


def test_files_alike_at_their_head_are_two(spark, tmp_path):
    for folder, tail in (("a", "1"), ("b", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "p.cbl").write_text("X" * 500 + tail)
    assert files.ingest(spark, str(tmp_path)).count() == 2


def test_conditional_facts(spark):
    text = "       PROCEDURE DIVISION.\n           IF A = 1\n             CALL 'IN1'\n           END-IF\n           CALL 'OUT1'\n           EVALUATE B\n             WHEN 1\n             CALL 'IN2'\n           END-EVALUATE\n           CALL 'OUT2'\n"
    found = extract.facts(spark.createDataFrame([("P", text)], "p string, t string"), "p", "t", extract.COBOL)
    assert {r["called"]: r["conditional"] for r in extract.calls(found, "p").collect()} == {"IN1": True, "OUT1": False, "IN2": True, "OUT2": False}


def test_whole_text_facts_have_their_own_lines(spark):
    text = "EXEC CICS RETURN END-EXEC\n* EXEC CICS ABEND END-EXEC\nEXEC SQL COMMIT\n END-EXEC\nEXEC CICS RETURN END-EXEC EXEC CICS RETURN END-EXEC"
    found = extract.facts(spark.createDataFrame([("P", text)], "p string, t string"), "p", "t", extract.COBOL)
    assert sorted((r["line"], r["a"]) for r in found.where("kind in ('cics', 'sql')").collect()) == [(1, "RETURN"), (3, "COMMIT"), (5, "RETURN"), (5, "RETURN")]


def test_long_parts_are_chunks_of_their_own(spark):
    text = "head\nIDENTIFICATION DIVISION.\n" + "x " * 4000 + "\nDATA DIVISION.\nA.\nPROCEDURE DIVISION.\nB."
    got = extract.structured_chunks(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t", "cobol", 100).orderBy("k", "chunk").collect()
    assert [(r["k"], r["first_line"], r["n_lines"], r["starts_with"]) for r in got] == [(1, 0, 1, None), (1, 1, 2, "division"), (1, 3, 4, "division"), (2, 0, 1, None)]
    assert "\n".join(r["text"] for r in got if r["k"] == 1) == text


def test_sharing_has_classes_instead_of_all_pairs(spark):
    uses = spark.createDataFrame([(c, t) for c in range(1, 6) for t in ("hot",)] + [(6, "hot"), (6, "own"), (7, "own"), (None, "hot"), (8, None)], "c int, t string")
    assert sorted(one(relations.sharing(uses, "c", "t"))) == [(1, 2, "same_targets"), (1, 3, "same_targets"), (1, 4, "same_targets"), (1, 5, "same_targets"), (1, 6, "shares"), (6, 7, "shares")]


def test_line_chunks_like_a_loop(spark, sf_dir):
    from stratalith.plans import catalog

    got = {(r["doc_id"], r["chunk"]): (r["first_line"], r["n_lines"], r["n_chars"]) for r in catalog.QUERIES["line_chunks"](spark, sf_dir).collect()}
    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        parts, used = [], 0
        for i, line in enumerate(r["text"].split("\n")):
            if not parts or used + len(line) > 3000:
                parts.append((i, [line]))
                used = len(line)
            else:
                parts[-1][1].append(line)
                used += len(line)
        expected |= {(r["doc_id"], k): (i, len(x), len("\n".join(x))) for k, (i, x) in enumerate(parts)}
    assert got == expected
