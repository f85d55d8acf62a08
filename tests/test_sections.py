"""Sections and chunks against plain loops, on odd texts."""

import random

from pyspark.sql import functions as F

from stratalith.operators import sections as S


def test_packed_is_a_plain_fold(spark):
    rnd = random.Random(7)
    rows = [(k, i, rnd.choice([0, 1, 5, 9, 30])) for k in range(30) for i in range(rnd.randint(1, 40))]
    for most in (None, 4):
        want, state = {}, {}
        for k, i, w in rows:
            chunk, total, n = state.get(k, (1, 0, 0))
            if n and (total + w > 20 or (most and n >= most)):
                chunk, total, n = chunk + 1, 0, 0
            state[k] = (chunk, total + w, n + 1)
            want[k, i] = chunk
        got = S.packed(spark.createDataFrame(rows, "k long, i int, w int").repartition(4), ["k"], "i", F.col("w"), 20, most)
        assert {(r["k"], r["i"]): r["chunk"] for r in got.collect()} == want


def test_sections_cover_all_lines(spark):
    text = "* head\n       IDENTIFICATION DIVISION.\n       PROCEDURE DIVISION.\n       WORK SECTION.\n       A-1.\n" + "           MOVE A\n             TO B.\n" * 40 + "       EXIT.\n       END-IF.\n       B-2.\n\n           STOP RUN."
    rows = S.sections(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no boundary\n" * 3)], "k long, t string"), "k", "t", 100, 20).orderBy("k", "first").collect()
    one = [r for r in rows if r["k"] == 1]
    assert [(r["type"], r["name"]) for r in one if r["part"] == 1] == [("DIVISION", "IDENTIFICATION"), ("DIVISION", "PROCEDURE"), ("SECTION", "WORK"), ("PARAGRAPH", "A-1"), ("PARAGRAPH", "B-2")]
    assert all(a["last"] + 1 == b["first"] for a, b in zip(one, one[1:])) and one[-1]["last"] == text.count("\n") + 1
    assert all(r["n_tokens"] <= 100 and r["last"] - r["first"] < 20 for r in one)
    assert [(r["k"], r["type"], r["first"]) for r in rows if r["k"] > 1] == [(4, "CHUNK", 1)]


def test_chunks_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, None), (3, "\n\n \t\n"), (4, "x" * 5000)], "k long, t string")
    assert sorted((r["k"], r["chunk"], r["first"], r["last"], r["content"][:4]) for r in S.fixed_chunks(df, "k", "t", 2).collect()) == [(1, 1, 1, 2, "a\nb"), (1, 2, 3, 4, "c\nd"), (1, 3, 5, 5, "e"), (4, 1, 1, 1, "xxxx")]
    assert [(r["chunk"], r["n_tokens"]) for r in S.token_chunks(df.where("k = 4"), "k", "t").collect()] == [(1, 1250)]


def test_graph_caps_have_a_total_order(spark):
    rows = [("c", f"d{i}", "CALL") for i in range(9)] + [("d3", "c", "COPY"), ("c", "c", "CALL"), (None, "c", "CALL"), ("c", "d1", "AAA")]
    got = S.around(spark.createDataFrame(rows, "source string, dependent string, relationship string").repartition(5)).where("component = 'c'").orderBy("side", "rank").collect()
    assert [(r["side"], r["neighbour"], r["relationship"], r["n_side"], r["n_nodes"], r["complexity"]) for r in got] == [
        ("downstream", f"d{i}", "AAA" if i == 1 else "CALL", 9, 7, "medium") for i in range(5)] + [("upstream", "d3", "COPY", 1, 7, "medium")]
