"""The pipeline's stages, each on its own input, against brute force."""

import random
import re

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def ids(df):
    return [r[0] for r in df.select("doc_id").collect()]


def test_columns_stay(outputs):
    first = outputs[0][0].columns
    assert all(after.columns == first for _, after in outputs[:-1])


def test_quality_keeps_good(outputs, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(outputs[0][1]))
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) / len(good) > 0.98 and sum(i in kept for i in bad) / len(bad) < 0.1


def test_exact_leaves_each_text_once(outputs):
    def bare(df):
        return [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in df.collect()]

    before, after = map(bare, outputs[1])
    assert sorted(set(before)) == sorted(after)


def test_near_and_substring_shrink(outputs):
    for before, after in outputs[2:4]:
        a, b = ids(before), ids(after)
        assert set(b) <= set(a) and len(set(b)) == len(b)
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[3][1].collect())


def test_rows_without_or_with_a_repeated_id_stay(spark):
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(60)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (2, texts[4]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (P.exact, P.near, P.substring):
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert sorted(r["text"] for r in docs.collect()) == sorted(texts)
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == set(rows) - {(None, texts[4])}


def near_docs():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    rows = []
    for g in range(12):  # chains of copies with one more word altered each
        t = [word() for _ in range(150)]
        for _ in range(g % 5 + 1):
            rows.append((len(rows), " ".join(t)))
            t = list(t)
            t[rnd.randrange(150)] = word()
    return [*rows, (None, " ".join(word() for _ in range(90))), (900, ""), (901, None), (902, "two words")]


def test_near_leaves_one_of_each_component(spark):
    rows = near_docs()
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").split()) else None for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= P.PERCENT * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    left = P.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    of = {(i, t): g for (i, t), g in zip(rows, group, strict=True)}
    assert sorted(of[r["doc_id"], r["text"]] for r in left) == sorted(set(group))


def test_substring_cuts_repeats_and_nothing_else(spark):
    rnd = random.Random(5)
    prose = lambda n: [("".join(rnd.choice("abcdefgh") for _ in range(7))) for _ in range(n)]
    rows, passages = [], []
    for g in range(15):
        shared = prose(70)
        passages.append(shared)
        for _ in range(g % 3 + 2):
            rows.append((len(rows), " ".join(prose(40) + shared + prose(40))))
    clean = [(500 + k, " ".join(prose(100))) for k in range(20)] + [(600, ""), (601, None), (None, " ".join(prose(30)))]
    left = {r["doc_id"]: r["text"] for r in P.substring(spark, spark.createDataFrame(rows + clean, "doc_id long, text string"), SF).collect()}
    assert len(left) == len(rows) + len(clean) and all(left[i] == t for i, t in clean)
    for shared in passages:
        inner = " ".join(shared[20:50])
        holders = [i for i, t in rows if inner in t]
        assert [i for i in holders if inner in left[i]] == holders[:1] and left[holders[0]] == rows[holders[0]][1]
        for i in holders[1:]:
            before, words = rows[i][1].split(), left[i].split()
            assert words[:40] == before[:40] and words[-40:] == before[-40:] and len(words) <= 80 + 30


def test_every_row_is_in_or_out(outputs, spark):
    """A row goes only for the reason of its stage: low score, equal text, linked text, or nothing left of it."""
    from pyspark.sql import functions as F

    (raw, good), (_, single), (_, apart), (_, cut), (_, packed) = outputs
    n = [df.count() for df in (raw, good, single, apart, cut)]
    model = P.quality_gam.learn(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    assert n[1] == P.quality_gam.score(raw, model).where(f"score >= {P.quality_gam.THRESHOLD}").count()
    assert n[2] == good.select(P.exact_dedup.normalised(F.col("text"))).distinct().count()
    assert n[3] == P.near_dedup.near_duplicates(single, P.PERCENT).where("kept").count()
    whole = P.substring_dedup.repeated_passages(apart).where("removed").groupBy("doc_id").agg(F.sum("n_removed_words").alias("n"))
    gone = apart.join(cut, "doc_id", "left_anti").join(whole, "doc_id")
    assert n[3] - n[4] == gone.count() and gone.where(F.size(F.split(F.trim("text"), r"\s+")) > F.col("n")).count() == 0
    assert packed.select("doc_id").distinct().count() == n[4]


def test_all_documents_are_packed(outputs):
    before, after = outputs[4]
    assert set(ids(before)) == set(ids(after))


def test_run(spark):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
