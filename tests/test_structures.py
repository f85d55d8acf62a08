"""Merges, JSON repair, layouts, mentions, bucketed tables, indexes, the catalogue and ring buffers, against plain versions."""

import datetime as dt
import json
import os
import random
import re

import pytest

from stratalith.operators import extract, json_repair, layout, mentions, merge
from stratalith.sources import buckets, catalogue
from stratalith.streaming import rings


def test_merge_by_types(spark):
    rows = [(1, 1, '{"a": "x", "b": [1, 2], "c": "t", "d": true, "e": [], "f": null}'), (1, 2, '{"a": ["y", "x"], "b": 3.5, "c": 7, "d": 2}'), (2, 1, "no json"), (2, 2, None), (2, 3, "[1]"), (3, 1, '{"a": {"k": [1, "z"]}}')]
    got = {(r["g"], r["name"]): (r["rule"], r["n"], r["texts"], r["mean"], r["first"]) for r in merge.merged(spark.createDataFrame(rows, "g long, i long, j string"), "g", "j", ["i"]).collect()}
    assert got == {
        (1, "a"): ("texts", 3, ["x", "y"], None, None), (1, "b"): ("mean", 3, None, 6.5 / 3, None), (1, "c"): ("first", 2, None, None, '"t"'), (1, "d"): ("mean", 2, None, 1.5, None),
        (1, "f"): ("first", 1, None, None, "null"), (3, "a"): ("first", 1, None, None, '{"k":[1,"z"]}')}


REPAIRS = {
    '{"a": 1, "b": [1, 2': {"a": 1, "b": [1, 2]}, "{a: hello world, b: true}": {"a": "hello world", "b": True}, 'See:\n```json\n{"y": [1,,2,],}\n``` {"z": 1}': {"y": [1, 2]}, '{"a": {"b": {"c": "unfini': {"a": {"b": {"c": "unfini"}}},
    '[{"a":1} {"b":2}]': [{"a": 1}, {"b": 2}], '{"a" 1 "b" 2}': {"a": 1, "b": 2}, '{{"a": 1}}': {"a": 1}, '{"a":}': {"a": None}, '{"a","b":2}': {"a": None, "b": 2}, '{"a": "x\ny"}': {"a": "x\ny"}, '{"t": "tail\\': {"t": "tail"},
    '{"a":1]}': {"a": 1}, '{"k": None, "n": -0.5e3, "z": 007}': {"k": None, "n": -500.0, "z": "007"}, '{"a": "say "hi" now"}': {"a": 'say "hi" now'}, "{'it': 'isn't it'}": {"it": "isn't it"}, '{"p": "C:\\dir\\x"}': {"p": "C:\\dir\\x"},
    "[": [], '{"a": NaN}': {"a": None}, '{"a": 1 // why\n, /* not */ "b": 2}': {"a": 1, "b": 2}, "no json": None, "": None, None: None, "}": None,
}


@pytest.mark.parametrize("text", REPAIRS)
def test_repairs(text):
    got = json_repair.repaired(text)
    assert (got and json.loads(got)) == REPAIRS[text] if got else REPAIRS[text] is None


def test_truncated_json_keeps_what_was_there(spark):
    rnd = random.Random(3)
    def value(depth):
        kind = rnd.randrange(6 if depth else 4)
        return [1.5, "te xt", None, "q\"u\\o", None, None][kind] if kind < 4 else {f"k{i}": value(depth - 1) for i in range(3)} if kind == 4 else [value(depth - 1) for _ in range(3)]
    texts = [json.dumps({f"a{i}": value(3) for i in range(4)}) for _ in range(30)]
    cut = [t[: rnd.randint(2, len(t))] for t in texts]
    rows = json_repair.repair(spark.createDataFrame([(i, t) for i, t in enumerate(cut + texts)], "i long, t string"), "t").collect()
    for r in rows:
        whole = json.loads((texts + texts)[r["i"]])
        found = json.loads(r["repaired"])
        assert list(found) == list(whole)[: len(found)] or list(found)[:-1] == list(whole)[: len(found) - 1]  # the last key may be cut itself
        for k in list(found)[:-1]:
            assert found[k] == whole[k]
        assert r["i"] < 30 or found == whole


def test_layouts(spark):
    text = """       01  REC.
           05  A PIC X(3).
           05  G OCCURS 2 TO 4 TIMES DEPENDING ON A.
               10  B PIC S9(5) COMP-3.
               10  C PIC 9(4) COMP.
               10  H OCCURS 2 TIMES PIC X.
           05  R REDEFINES G.
               10  S PIC X(40).
               10  T PIC 9(9) COMP.
           05  Z PIC 99.
             88  Z-NONE VALUE 0.
       01  OTHER PIC X(7)."""
    sources = spark.createDataFrame([(1, text), (2, "       01  EMPTY.")], "program long, source string")
    rows = layout.tree(extract.data_items(extract.facts(sources, "program", "source", extract.only(extract.COBOL, "data_item")), "program"), "program").orderBy("program", "line").collect()
    got = [(r["name"], r["parent"], r["offset"], r["element_bytes"], r["bytes"], r["children"]) for r in rows if r["program"] == 1]
    assert got == [
        ("REC", None, 0, 47, 47, ["A", "G", "R", "Z"]), ("A", "REC", 0, 3, 3, []), ("G", "REC", 3, 7, 28, ["B", "C", "H"]), ("B", "G", 3, 3, 3, []), ("C", "G", 6, 2, 2, []), ("H", "G", 8, 1, 2, []),
        ("R", "REC", 3, 44, 44, ["S", "T"]), ("S", "R", 3, 40, 40, []), ("T", "R", 43, 4, 4, []), ("Z", "REC", 31, 2, 2, []), ("OTHER", None, 0, 7, 7, [])]
    assert {r["name"]: (r["depends_on"], r["path"], r["occurs"]) for r in rows}["H"] == (None, "REC.G.H", 2)


def test_mentions_equal_brute_force(spark):
    rnd = random.Random(5)
    names = ["CUST-FILE", "cust_file", "ORD", "ord.dat", "É-1", " ", None, "X"]
    words = ["CUST-FILE", "Cust_File", "custfile", "ord", "ORD.DAT", "ORD.X", "MY-ORD", "é_1", "x", "X1", "a.x", "ord-", "(ord)"]
    texts = {i: "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 4))) for i in range(80)} | {90: None}
    df = spark.createDataFrame(list(texts.items()), "k long, t string").repartition(5)
    found = mentions.mentions(df, "k", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    want = {}
    for i, t in texts.items():
        for j, line in enumerate((t or "").split("\n")):
            for w in re.findall(r"[^\W_][\w-]*(?:\.[^\W_][\w-]*)*", line.upper().replace("_", "-")):
                for v in {w, w.split(".")[0]}:
                    for n in names:
                        if n and n.strip() and n.strip().upper().replace("_", "-") == v:
                            n_, a, b = want.get((n, i), (0, j + 1, 0))
                            want[n, i] = (n_ + 1, min(a, j + 1), j + 1)
    assert {(r["name"], r["k"]): (r["n"], r["first_line"], r["last_line"]) for r in found.collect()} == want
    top = mentions.capped(found, "k", 3).collect()
    assert all(r["n_texts"] == sum(n == r["name"] for n, _ in want) and r["rank"] <= 3 for r in top)
    assert [r["k"] for r in sorted((r for r in top if r["name"] == "ORD"), key=lambda r: r["rank"])] == [k for _, k in sorted((-v[0], k) for (n, k), v in want.items() if n == "ORD")[:3]]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("relation", buckets.RELATIONS)
def test_upserts_leave_other_buckets_alone(spark, tmp_path, relation):
    keys, folder = buckets.RELATIONS[relation], str(tmp_path)
    schema = ", ".join(f"{k} {'int' if k == 'line' else 'string'}" for k in keys) + ", version int, note string"
    def row(i, version, note):
        return (*[i if k == "line" else f"{k}{i}" for k in keys], version, note)
    path = f"{folder}/{relation}"
    assert buckets.save_relation(spark.createDataFrame([row(i, 1, "old") for i in range(100)], schema), folder, relation, "version", 16) == 16
    before = files(path)
    change = spark.createDataFrame([row(3, 2, "new"), row(7, 0, "late"), row(200, 1, "more")], schema)
    touched = buckets.save_relation(change, folder, relation, "version", 16)
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert touched <= 3 and len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in same}) == touched
    rows = {r["line"]: r["note"] for r in buckets.table(spark, path).collect()}
    assert len(rows) == 101 and rows[3] == "new" and rows[7] == "old" and rows[200] == "more"
    buckets.save_relation(change, folder, relation, "version", 16)
    assert {r["line"]: r["note"] for r in buckets.table(spark, path).collect()} == rows
    assert buckets.save_relation(change.limit(0), folder, relation, "version", 16) == 0


def test_a_broken_upsert_is_resumed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    buckets.upsert(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), path, ["k"], "v", 4)
    monkeypatch.setattr(buckets, "_put", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        buckets.upsert(spark.createDataFrame([(1, 2)], "k int, v int"), path, ["k"], "v", 4)
    monkeypatch.undo()
    assert {(r["k"], r["v"]) for r in buckets.table(spark, path).collect()} == {(1, 2), (2, 1)}


def test_an_updated_index_is_a_rebuilt_one(spark, tmp_path):
    rnd, path = random.Random(1), str(tmp_path / "index")
    schema = "file long, vec_id long, embedding array<double>, version int"
    state = {}
    for version in range(1, 6):
        batch = []
        for f in rnd.sample(range(20), 8):
            n = rnd.randint(0, 3)
            state[f] = [(f, 100 * f + i, [rnd.random(), rnd.random()], version) for i in range(n)]
            batch += state[f] or [(f, None, None, version)]
        df = spark.createDataFrame(batch, schema)
        buckets.update_index(df, path, "file", "version", 8)
        if version == 3:
            again = df
    buckets.update_index(again, path, "file", "version", 8)  # an old batch that comes again
    want = sorted(r for rows in state.values() for r in rows)
    assert sorted(tuple(r) for r in buckets.index(spark, path, "embedding").select("file", "vec_id", "embedding", "version").collect()) == want


def test_catalogue_counts(spark, tmp_path):
    rows = [(1, "a", None, [1]), (2, None, 2.5, None), (3, "ccc", None, None)]
    spark.createDataFrame(rows, "i int, s string, d double, l array<int>").write.parquet(str(tmp_path / "t"))
    catalogue.register(spark, {"t_one": str(tmp_path / "t")}, "probe")
    got = {r["column"]: (r["type"], r["n_rows"], r["n_nulls"], r["least"], r["greatest"], r["longest"]) for r in catalogue.scan(spark, "probe").collect()}
    assert got == {"i": ("int", 3, 0, "1", "3", 4), "s": ("string", 3, 1, None, None, 3), "d": ("double", 3, 2, "2.5", "2.5", 8), "l": ("array<int>", 3, None, None, None, None)}


def test_rings_evict_forget_and_restart(spark, tmp_path):
    base, folder, out = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), str(tmp_path / "in"), []
    schema = "user long, ts timestamp, o long, v double"
    def feed(rows):
        spark.createDataFrame([(k, base + dt.timedelta(minutes=m), i, float(v)) for i, (k, m, v) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(folder)
    def run():
        stream = rings.ring(spark.readStream.schema(schema).parquet(folder), "user", "ts", "o", "v", 5, 2, "30 minutes")
        got = []
        q = stream.writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append({r["key"]: (r["n"], r["total"]) for r in got})
    feed([(1, m, 1) for m in range(8)] + [(2, 0, 10)])
    run()
    feed([(1, 9, 100), (3, 60, 7)])
    run()  # from the checkpoint
    feed([(1, 5, 1000), (3, 200, 5)])  # the first is late by the watermark of an hour and a half before
    run()
    assert out[0] == {1: (5, 5.0), 2: (1, 10.0)} and out[1][1] == (5, 104.0) and out[1][3] == (1, 7.0)
    assert out[2].get(3) == (1, 5.0) and out[2].get(1, (0, 0.0)) == (0, 0.0) and out[2][2] == (0, 0.0)


def test_ring_of_a_batch_is_that_of_the_stream(spark, sf_dir):
    from stratalith.plans import catalog

    stream = {r["key"]: (r["n"], r["total"]) for r in catalog.QUERIES["stream_rings"](spark, sf_dir).collect() if r["n"]}
    batch = {r["key"]: (r["n"], r["total"]) for r in rings.ring_of(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id", "value").collect()}
    assert stream and stream.items() <= batch.items()
