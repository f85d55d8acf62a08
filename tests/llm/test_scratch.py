"""Scratch tables belong to their results; stages take odd tables."""

import random
from pathlib import Path

import pytest

import corpus_pipeline as P
from stratalith.llm import common, exact_dedup, queries

SF = "/root/testdata/sf0.001"


def test_a_pipeline_run_leaves_other_results_alone(spark):
    live = {name: f(spark, SF) for name, f in queries.QUERIES.items()}
    assert P.run(spark, SF).count() > 0
    assert all(df.count() > 0 for df in live.values())


def test_settled_deletes_its_own_tables_alone(spark):
    def there():
        """What this test has made; others may use the folder, too."""
        root = Path(common.shared_dir(spark).removeprefix("file://").removeprefix("file:"))
        return {p.name for p in root.iterdir() if p.name.split("-")[0] in ("settled_mine", "settled_a", "settled_b", "settled_c", "settled_inner")}

    before = there()
    mine = common.table(spark.range(5), "settled_mine")
    inner = common.settled(spark, "settled_inner", lambda: common.table(common.table(spark.range(3), "settled_a").union(spark.range(2)), "settled_b"))
    assert sorted(n.split("-")[0] for n in there() - before) == ["settled_inner", "settled_mine"]
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, "settled_fails", lambda: common.table(spark.range(3), "settled_c") and 1 / 0)
    assert len(there() - before) == 2 and mine.count() == inner.count() == 5


def test_one_of_repeated_rows_stays(spark):
    rows = [(7, "q q"), (7, "q q"), (7, "q  q"), (7, "q  q"), (9, "q q"), (1, "z"), (None, "y "), (2, "y"), (None, "x"), (3, "x"), (4, None), (4, "")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [r for r in got if r["kept"]]
    assert len(got) == len(rows) and len(kept) == len({r["text_sha256"] for r in got}) == 5
    assert {(r["keep_id"], r["group_size"]) for r in kept} == {(7, 5), (1, 1), (None, 2), (3, 2), (4, 2)}


def test_stages_with_int_ids_and_clashing_names(spark):
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(n))
    shared = prose(70)
    rows = [(i, f"{prose(40)} {shared} {prose(40)}", "a", "b", i, 1, 2, 3) for i in range(4)] + [(None, prose(60), "a", "b", 1, 1, 2, 3), (None, None, "a", "b", 1, 1, 2, 3), (5, "same  text", "", "", 0, 1, 2, 3), (5, "same text", "", "", 0, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, sha string, ROW string, n_chars int, cut_id int, own int, size int")
    for stage in (P.exact, P.near, P.substring):
        after = stage(spark, docs, SF)
        assert after.dtypes == docs.dtypes
        docs = spark.createDataFrame(after.collect(), docs.schema)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    assert shared in texts[0] and not any(shared in texts[i] for i in (1, 2, 3)) and texts[5] == "same  text" and docs.count() == 7
    assert P.pack(spark, docs, SF).select("doc_id").distinct().count() == 6


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    for stage in (P.exact, P.near, P.substring, P.pack):
        assert stage(spark, docs, SF).count() == 0
