"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from stratalith.llm import chat_repair as C

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def order(rows):
    """(turn, role, text) in the order of a conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1], hashlib.sha256(r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by uniform-cost search over role strings."""
    found, heap, done = faults(rows), [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, lines
        if (i, roles) in done:
            continue
        done.add((i, roles))
        def push(more, letter, step, initial, line):
            if not initial or re.fullmatch(r"s?(ua)*u?", roles + initial):  # no other beginning can become good
                heapq.heappush(heap, (cost + more, audit + letter, i + step, roles + initial, lines + line))
        for role in ("user", "assistant"):
            push(5, "I", 0, role[0], (role + ":",))
        if i < len(rows):
            _, role, text = rows[i]
            push(2, "D", 1, "", ())
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] else 0
                push(more, "K", 1, role[:1] or "-", (f"{role}:{text}",))
                for new in ("user", "assistant"):
                    push(more + 1, "R", 1, new[0], (f"{new}:{text}",))


def expected(rows):
    rows = order(rows)
    cost, audit, lines = cheapest(rows)
    found, turns = faults(rows), {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit), "\n".join(lines)


def conversations(n, most=7):
    rnd = random.Random(11)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Use"], ["Yes.", "no", "Well?", "", " \n", None, "fine!\t", "ok", "Sure. "]
    return {k: [(rnd.choice([None, 0, 1, 2, 3, 5, 9]), rnd.choice(roles), rnd.choice(texts)) for _ in range(rnd.randint(1, most))] for k in range(n)}


def got(found):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv"]: tuple(r[x] for x in names) for r in found.collect()}


@pytest.mark.parametrize("chunk", [1 << 16, 2])
def test_edits_and_rows_equal_a_search(spark, chunk):
    talks = conversations(150)
    df = spark.createDataFrame([(k, *r) for k, rows in talks.items() for r in rows], SCHEMA).repartition(5)
    found = C.edits(df, chunk)
    wanted = {k: expected(rows) for k, rows in talks.items()}
    assert got(found) == {k: w[0] for k, w in wanted.items()}
    lines = {}
    for r in sorted(C.repaired(df, found).collect(), key=lambda r: (r["conv"], r["position"])):
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    assert {k: "\n".join(v) for k, v in lines.items()} == {k: w[1] for k, w in wanted.items() if w[1]}
    shas = {r["conv"]: r["repaired_sha256"] for r in C.digests(C.repaired(df, found)).collect()}
    assert shas == {k: hashlib.sha256(w[1].encode()).hexdigest() for k, w in wanted.items() if w[1]}


def test_long_conversation_in_many_chunks(spark):
    rnd = random.Random(3)
    rows = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["One.", f"{t}!", "cut", ""])) for t in range(3000)]
    rows += [(7, 4000, "user", "copy.")] * 500 + [(8, 1, "user", "a."), (8, 2, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    one, many = got(C.edits(df)), got(C.edits(df, 100))
    assert one == many and len(one[7][6]) >= 3500 and one[8] == (0, 0, 0, 0, 0, 0, "KK")


def test_powers_are_repeated_steps():
    for symbol in range(9):
        step, out = C.run_matrix(symbol, 1), C.UNIT
        for k in range(1, 20):
            out = C.times(out, step)
            assert out == C.run_matrix(symbol, k)


def test_damage_and_digest(spark):
    rows = [(c, t, r, f"Line {c} {t}.") for c in range(60) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2 :])] + [(None, None, None, None), (None, 3, "user", "Hm.")]
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, [])
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x
        talks[c] += [(t, "user" if way == 4 else r, x)] * (0 if way == 0 else 2 if way == 3 else 1)
    out = C.trial(spark.createDataFrame(rows, SCHEMA)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    assert len(out) == len(talks)
    for r in out:
        want, body = expected(talks[r["conv_id"]])
        assert tuple(r[x] for x in names) == want and r["repaired_sha256"] == hashlib.sha256(body.encode()).hexdigest()


def test_empty_and_clashing_names(spark):
    assert C.trial(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 1, "x"), (1, 1, "assistant", "x" * 300000 + ".", 2, "y")], SCHEMA + ", conv long, key string")
    assert got(C.edits(df)) == {1: (0, 0, 0, 0, 0, 0, "KK")}
