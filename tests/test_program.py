"""Statements, flow of control and of values, against small programs read by hand or by a plain search."""

import random

from stratalith.operators import program as P

TEXT = """000100 IDENTIFICATION DIVISION.                                         IDENT001
000200 PROGRAM-ID. MAIN.                                                IDENT002
000300 DATA DIVISION.
000400 01  TEXT-A PIC X(20) VALUE 'MOVE A TO B.'.
000500 PROCEDURE DIVISION USING IN-A
000600     OUT-B.
000700 FIRST-PART.
000800*    MOVE GONE TO AWAY
000900     MOVE 'IF X. MOVE' TO W-1 IF A > B PERFORM SECOND-PART
001000         THRU LAST-PART
001100     ELSE CALL 'SUB' USING W-1
001200         OUT-B.
001300     CALL 'SUB2'.
001400     MOVE IN-A TO LONG-
001500-        NAME.
001600     EXEC SQL DELETE FROM T WHERE A = :B END-EXEC
001700     DISPLAY 'A LITERAL THAT
001800-    ' GOES ON'.
001900 SECOND-PART.
002000     EXIT.
002100 LAST-PART.
002200     GO TO FIRST-PART."""


def test_statements_of_fixed_form(spark):
    rows = P.statements(spark.createDataFrame([("m", TEXT), ("n", None), ("o", "PROCEDURE DIVISION.\nA.\n  STOP RUN.")], "program string, source string"), "program", "source").orderBy("n").collect()
    got = [(r["line"], r["paragraph"], r["verb"], r["body"], r["conditional"]) for r in rows if r["program"] == "m"]
    assert got == [
        (5, None, "PROCEDURE", "DIVISION USING IN-A OUT-B", False), (7, "FIRST-PART", "LABEL", "FIRST-PART", False), (9, "FIRST-PART", "MOVE", "'IF X. MOVE' TO W-1", False),
        (9, "FIRST-PART", "IF", "A > B", False), (9, "FIRST-PART", "PERFORM", "SECOND-PART THRU LAST-PART", True), (11, "FIRST-PART", "ELSE", "", True), (11, "FIRST-PART", "CALL", "'SUB' USING W-1 OUT-B", True),
        (13, "FIRST-PART", "CALL", "'SUB2'", False), (14, "FIRST-PART", "MOVE", "IN-A TO LONG-NAME", False), (16, "FIRST-PART", "EXEC", "SQL DELETE FROM T WHERE A = :B", False), (16, "FIRST-PART", "END-EXEC", "", False),
        (17, "FIRST-PART", "DISPLAY", "'A LITERAL THAT GOES ON'", False), (19, "SECOND-PART", "LABEL", "SECOND-PART", False), (20, "SECOND-PART", "EXIT", "", False), (21, "LAST-PART", "LABEL", "LAST-PART", False),
        (22, "LAST-PART", "GO", "TO FIRST-PART", False)]
    assert [r["verb"] for r in rows if r["program"] == "o"] == ["PROCEDURE", "LABEL", "STOP"]


def walked(paras, first, last):
    """Places, exits and loops of a range, paragraph by paragraph; paras: (gotos, leaves by GO TO, ends)."""
    seen, todo, exits = set(), [first], set()
    while todo:
        p = todo.pop()
        if p in seen:
            continue
        seen.add(p)
        gotos, jumps, ends = paras[p]
        todo += gotos
        if ends or p == last or (p == len(paras) - 1 and not jumps):
            exits.add(p)
        if not ends and not jumps and p != last and p + 1 < len(paras):
            todo.append(p + 1)
    return seen, exits, any(t <= p and t in seen for p in seen for t in paras[p][0])


def test_control_flow_equals_a_walk(spark):
    rnd, texts, want = random.Random(2), [], {}
    for k in range(60):
        n = rnd.randint(1, 9)
        names, paras, performs, text = [f"P{k}-{i}" for i in rnd.sample(range(50), n)], [], [], ["PROCEDURE DIVISION."]
        for i in range(n):
            text.append(f"{names[i]}.")
            if rnd.random() < 0.5:
                a, b = sorted(rnd.choices(range(n), k=2))
                b = b if rnd.random() < 0.5 else a
                performs.append((i, a, b))
                text.append(f"    PERFORM {names[a]}" + (f"\n THRU {names[b]}" if b != a else "") + " UNTIL X = 1.")
            gotos = []
            if rnd.random() < 0.3:
                gotos.append(rnd.randrange(n))
                text.append(f"    IF A = 1 GO TO {names[gotos[0]]}.")
            kind = rnd.choice(["", "", "go", "stop", "cond"])
            jumps = ends = False
            if kind == "go":
                gotos.append(rnd.randrange(n))
                jumps = True
                text.append(f"    GO TO {names[gotos[-1]]}.\n    GO TO {names[0]}.")
            if kind == "stop":
                ends = True
                text.append("    STOP RUN.")
            if kind == "cond":
                text.append("    IF B = 1 STOP RUN END-IF GO TO NOWHERE DEPENDING ON X.")
            paras.append((gotos, jumps, ends))
        texts.append((k, "\n".join(text)))
        for j, (a, b) in enumerate(sorted({(a, b) for _, a, b in performs})):
            seen, exits, loops = walked(paras, a, b)
            want[k, f"PATH_{j + 1}"] = (names[a], names[b], [names[p] for p in sorted(seen)], [names[p] for p in sorted(exits)], sorted({names[x] for i, x, _ in performs if i in seen}), loops)
    st = P.statements(spark.createDataFrame(texts, "program long, source string"), "program", "source")
    got = {(r["program"], r["path_id"]): (r["entry_point"], r["last_point"], r["paragraphs"], r["exit_points"], r["called_paragraphs"], r["loops"]) for r in P.control_flow(st, "program").collect()}
    assert got == want


def test_sections_are_ranges(spark):
    text = "PROCEDURE DIVISION.\nMAIN SECTION.\nA.\n PERFORM WORK STOP RUN.\nWORK SECTION.\nB.\n CONTINUE.\nC.\n GO TO B.\nD.\n EXIT."
    st = P.statements(spark.createDataFrame([("x", text)], "program string, source string"), "program", "source")
    r = P.control_flow(st, "program").collect()
    assert [(x["entry_point"], x["last_point"], x["paragraphs"], x["loops"]) for x in r] == [("WORK", "D", ["B", "C"], True)]


def test_values_through_three_programs(spark):
    one = "PROCEDURE DIVISION.\nA.\n MOVE SRC-A TO WRK (3) OF REC X-2\n COMPUTE TOT ROUNDED = WRK * 2 + RATE - 'LIT'\n CALL 'TWO' USING TOT RES.\n MOVE RES TO OUT-Z."
    two = "PROCEDURE DIVISION USING P-1\n P-2.\nA.\n ADD P-1 TO KEEP GIVING HELD\n CALL \"THREE\" USING BY REFERENCE HELD P-2."
    three = "PROCEDURE DIVISION USING L-1, L-2.\nA.\n DIVIDE L-1 BY 2 GIVING L-2 REMAINDER REST\n MOVE L-2 TO L-1."
    df = spark.createDataFrame([(1, "ONE", one), (2, "TWO", two), (3, "THREE", three)], "program long, name string, source string")
    flows = P.value_flow(P.statements(df, "program", "source"), "program", df)
    edges = {(r["program"], r["source"], r["to_program"], r["target"], r["kind"]) for r in flows.collect()}
    assert edges == {
        (1, "SRC-A", 1, "WRK", "M"), (1, "SRC-A", 1, "X-2", "M"), (1, "WRK", 1, "TOT", "C"), (1, "RATE", 1, "TOT", "C"), (1, "RES", 1, "OUT-Z", "M"), (1, "TOT", 2, "P-1", "P"), (1, "RES", 2, "P-2", "P"),
        (2, "P-1", 2, "HELD", "A"), (2, "KEEP", 2, "HELD", "A"), (2, "HELD", 3, "L-1", "P"), (2, "P-2", 3, "L-2", "P"), (3, "L-1", 3, "L-2", "A"), (3, "L-1", 3, "REST", "A"), (3, "L-2", 3, "L-1", "M"),
        (3, "L-1", 2, "HELD", "R"), (3, "L-2", 2, "P-2", "R")}
    reach = {(r["field"], r["to_program"], r["to_field"]): (r["hops"], r["kinds"]) for r in P.lineage(flows, spark.createDataFrame([(1, "SRC-A")], "program long, field string")).collect()}
    assert reach["SRC-A", 3, "L-2"] == (6, "MCPAPA") and reach["SRC-A", 2, "P-2"] == (7, "MCPAPAR") and reach["SRC-A", 1, "TOT"] == (2, "MC") and ("SRC-A", 1, "OUT-Z") not in reach
    assert {(r["program"], r["field"]) for r in P.lineage(flows).collect()} == {(1, "SRC-A"), (1, "RATE"), (2, "KEEP")} | {(1, "RES")}


def test_message_calls_by_order(spark):
    calls = {1: "MQPUT MQGET", 2: "MQGET MQPUT", 3: "MQCONN MQOPEN MQPUT1 MQBEGIN MQPUT MQCMIT MQGET MQCLOSE MQCONNX MQSUB MQGET", 4: "MQINQ MQPUT MQINQ MQBACK MQCMIT MQINQ MQGET", 5: "mqput mqget mqput mqput mqget mqput"}
    df = spark.createDataFrame([(k, i, c) for k, cs in calls.items() for i, c in enumerate(cs.split())], "program long, i int, api string").repartition(3)
    flows = {}
    for r in P.message_flows(df, "program", ["i"], "api").collect():
        flows.setdefault((r["program"], r["flow"]), []).append((r["first"], r["last"]))
    assert {k: sorted(v) for k, v in flows.items()} == {
        (1, "request_reply"): [(1, 2)], (3, "request_reply"): [(3, 7)], (3, "fire_and_forget"): [(3, 3)], (3, "publish_subscribe"): [(10, 11)], (3, "persistent_messaging"): [(2, 8)], (3, "transactional_messaging"): [(4, 6)],
        (4, "request_reply"): [(2, 7)], (5, "request_reply"): [(1, 2), (3, 5)]}
    seq = [(r["program"], r["sequence"], r["type"], r["first"], r["last"]) for r in P.message_sequences(df, "program", ["i"], "api").orderBy("program", "sequence").collect()]
    assert seq == [
        (1, 1, "message_sequence", 1, 2), (2, 1, "message_sequence", 1, 2), (3, 1, "transaction_sequence", 1, 4), (3, 2, "transaction_sequence", 5, 6), (3, 3, "message_sequence", 7, 8), (3, 4, "message_sequence", 9, 11),
        (4, 1, "general_sequence", 1, 1), (4, 2, "transaction_sequence", 2, 6), (4, 3, "message_sequence", 7, 7), (5, 1, "message_sequence", 1, 6)]
