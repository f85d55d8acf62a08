"""Altered passages are found by overlapping paragraphs, wherever the alterations are."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalith.llm import near_dedup, textkit
from stratalith.llm import substring_dedup as S

CASES = [(60, []), (60, [30]), (60, [10]), (60, [5, 55]), (60, [20, 40]), (60, [15, 30, 45]), (50, [17, 34]), (200, [28, 57, 85, 114, 142, 171])]


def words(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(n)]


def test_altered_passages(spark):
    rnd = random.Random(5)
    texts, case = [], []
    for c, (n, at) in enumerate(CASES):
        for _ in range(40):
            first = words(rnd, n)
            second = [words(rnd, 1)[0] if k in at else w for k, w in enumerate(first)]
            texts += [" ".join(words(rnd, 80) + first + words(rnd, 80)), "\n".join(words(rnd, 70) + second + words(rnd, 90))]
            case.append(c)
    clean = len(texts)
    texts += [" ".join(words(rnd, 250)) for _ in range(150)]
    rows = S.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)).collect()
    gone = Counter()
    for r in rows:
        assert r["doc_id"] < clean
        gone[r["doc_id"]] += r["n_removed_words"]
    assert not any(gone[2 * k] for k in range(len(case)))  # the first copy stays
    for c, (n, at) in enumerate(CASES):
        ids = [2 * k + 1 for k in range(len(case)) if case[k] == c]
        assert sum(gone[i] > 0 for i in ids) >= 0.95 * len(ids)
        assert sum(gone[i] for i in ids) >= (0.9 * n - 5) * len(ids) and max(gone[i] for i in ids) <= n


def test_spans_end_where_texts_part(spark):
    rnd = random.Random(6)
    shared, tails = words(rnd, 70), [words(rnd, 40) for _ in range(30)]
    texts = [f"{' '.join(t)}\n\n {' '.join(shared)}\t{' '.join(reversed(t))}" for t in tails]
    for r in S.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]].split() == shared and r["n_removed_words"] == (70 if r["doc_id"] else 0)


def test_crowd_of_a_common_phrase_is_clean(spark):
    rnd = random.Random(7)
    phrase = words(rnd, 8)
    texts = [" ".join(words(rnd, 60) + phrase + words(rnd, 60)) for _ in range(300)]
    assert S.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0


def test_long_words_gaps_and_repeats(spark):
    rnd = random.Random(8)
    shared = words(rnd, 80)
    odd = [" ".join(shared[:40]) + " " + "x" * 400 + " " + " ".join(shared[40:]), " ".join(shared[:40]) + " " * 500 + " ".join(shared[40:]), " ".join(shared), "a " * 3000, "b a " * 900, "short", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(None, odd[2]), (2, odd[2])], "doc_id int, text string")
    got = {r["doc_id"]: r for r in S.repeated_passages(docs).collect() if r["doc_id"] < 3}
    assert set(got) == {0, 1, 2} and not got[0]["removed"]
    for i in (1, 2):
        assert sum(r["n_removed_words"] for r in S.repeated_passages(docs).collect() if r["doc_id"] == i) >= 74


@pytest.mark.parametrize("seed", range(3))
def test_reach_is_the_best_alignment(seed):
    rnd = random.Random(seed)
    a = [[rnd.randint(1, 3) for _ in range(S.SIDE)] for _ in range(60)]
    b = []
    for x in a:
        y = list(x)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(y))
            y[k : k + rnd.randint(0, 1)] = [rnd.randint(1, 9)] * rnd.randint(0, 2)
        b.append((y + [0] * S.SIDE)[: S.SIDE])
    left, right = S.reach(np.array(a, np.uint32), np.array(b, np.uint32))
    for x, y, i, j in zip(a, b, left.tolist(), right.tolist()):
        cost = {(0, 0): 0}
        for p in range(S.SIDE + 1):
            for q in range(S.SIDE + 1):
                ways = [cost[p - 1, q] + 1] if (p - 1, q) in cost else []
                ways += [cost[p, q - 1] + 1] if (p, q - 1) in cost else []
                ways += [cost[p - 1, q - 1] + (x[p - 1] != y[q - 1] or not x[p - 1])] if (p - 1, q - 1) in cost else []
                if ways and abs(p - q) <= S.SHIFT:
                    cost[p, q] = min(ways)
        assert max(i, j) - S.COST * cost[i, j] == max(max(p, q) - S.COST * c for (p, q), c in cost.items())


def test_seeds_are_least_of_windows():
    rnd = random.Random(3)
    texts = [" ".join(words(rnd, n)) for n in (0, 3, 15, 16, 17, 60)] + ["a b " * 40]
    p = S.Paragraphs(*textkit.flat(pa.array(texts)))
    got, want = set(p.seeds().tolist()), set()
    for a, b in zip(p.first[:-1], p.first[1:]):
        for k in range(a, b - S.WORDS - S.WINDOW + 2):
            want.add(k + int(np.argmin(p.shingles[k : k + S.WINDOW])))
    assert got == want


def test_chains_do_not_hang_on_batches(spark):
    rnd = random.Random(9)
    shared = words(rnd, 60)
    texts = [" ".join(words(rnd, 50) + [w if rnd.random() > 0.03 else words(rnd, 1)[0] for w in shared] + words(rnd, 50)) for _ in range(400)]
    texts += [" ".join(words(rnd, 160)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    try:
        for n in ("7", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got.append({(r["doc_id"], r["start"], r["end"], r["removed"]) for r in S.repeated_passages(docs).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got[0] == got[1] and {i for i, *_ in got[0]} <= set(range(400)) and len({i for i, *_, gone in got[0] if gone}) >= 395


def test_paragraphs_in_another_order_are_found_by_their_bands(spark):
    """Two runs of 21 words change places: each is too short around a seed, but four shingles in five of the whole paragraph agree."""
    rnd, texts = random.Random(11), []
    for _ in range(12):
        some = words(rnd, 41)
        data, starts, ends = _placed(some)
        some = [some[k] for k in np.argsort(textkit.word_hashes(data, starts, ends))]
        least, rest = some[0], some[1:]  # the least word begins the text, so that it is one paragraph
        left, right = [least, *rest[::2]], [least, *rest[1::2]]
        texts += [" ".join(left + right), " ".join(right + left)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert S.repeated_passages(docs, blocks=False).count() == 0
    found = {r["doc_id"] for r in S.repeated_passages(docs).where("removed").collect()}
    assert len(found) >= 11 and all(k % 2 for k in found)
    assert {r["doc_id"] for r in S.cuts(docs).collect()} == found


def _placed(some):
    data = np.frombuffer(" ".join(some).encode(), np.uint8)
    starts, ends, _ = textkit.words(data, np.array([0, len(data)]))
    return data, starts, ends


def test_gaps_between_words_are_kept_where_they_are_wide():
    texts = ["aa bb  cc\n\n\nd eeeee", "x y z w v"]
    p = S.Paragraphs(*textkit.flat(pa.array(texts)))
    got = p.steps(np.array([0, 1, 5]), np.array([5, 3, 10])).to_pylist()
    assert [list(x) for x in got] == [[2, 2, 2, 1, 5, 1, 1, 2, 3, 1], [2, 2, 1, 2], [1] * 5]


@pytest.mark.parametrize("blocks", [True, False])
def test_shared_keys_are_those_with_two_ids(spark, blocks):
    rnd = random.Random(12)
    passages = [words(rnd, 60) for _ in range(5)]
    texts = [" ".join(words(rnd, 40) + rnd.choice(passages) + words(rnd, 60)) for _ in range(60)] + ["", None, "short", "b a " * 200]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    bands = S.tune_bands()
    ids = {}
    for r in S._keys(docs, *bands, 22, blocks).collect():
        ids.setdefault(r["key"], set()).add(r["id"])
    got = [r["key"] for r in S._shared(docs, *bands, 22, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k, x in ids.items() if len(x) > 1} and got


def test_extremes_keep_two_ids_of_a_key():
    rnd = random.Random(13)
    rows = [(rnd.randint(-9, 9), rnd.randint(-3, 3)) for _ in range(200)] + [(99, 4)] * 5
    key, id_ = S.extremes(*(np.array(x, np.int64) for x in zip(*rows)))
    want = {k: {i for j, i in rows if j == k} for k, _ in rows}
    assert sorted(zip(key.tolist(), id_.tolist())) == sorted((k, i) for k, x in want.items() for i in {min(x), max(x)})
    assert all(len(x) == 0 for x in S.extremes(np.zeros(0, np.int64), np.zeros(0, np.int64)))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_texts_are_whole_however_batches_fall(size):
    rnd = random.Random(size)
    rows = sorted((rnd.randint(0, 4), rnd.randint(0, 2)) for _ in range(40))
    table = pa.table({"doc_id": [r[0] for r in rows], "text_key": [r[1] for r in rows], "n": range(40)})
    runs = [t.to_pydict() for t in S._whole(iter([table.to_batches()[0].slice(0, 0), *table.to_batches(max_chunksize=size)]))]
    assert [n for t in runs for n in t["n"]] == list(range(40)) and all(t["n"] for t in runs)
    seen = [set(zip(t["doc_id"], t["text_key"])) for t in runs]
    assert sum(len(x) for x in seen) == len(set(rows))


def test_links_in_a_crowd_do_not_grow_with_its_square(spark):
    """All of a crowd are alike: its blocks give a link for each member, not for each pair."""
    n = 300
    members = spark.createDataFrame([(k, 5, 0, 100) for k in range(n)], "rep long, lead long, tree int, size long")
    sets = spark.createDataFrame([(k, list(range(99)) + [1000 + k]) for k in range(n)], "doc_id long, shingles array<long>")
    none = spark.createDataFrame([], "node long, root long")
    links = near_dedup.crowd_links(members, none, lambda ids: sets, 80).collect()
    assert len(links) == n - 1
    pairs = spark.createDataFrame([], "a long, b long")
    got = near_dedup.closed(pairs, members, lambda ids: sets, 80).collect()
    assert {(r["node"], r["root"]) for r in got} == {(k, 0) for k in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_stars_have_the_components_of_their_links(seed):
    rnd = random.Random(seed)
    links = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    node, least = near_dedup.spanning(*(np.array(x) for x in zip(*links)))
    assert dict(zip(node.tolist(), least.tolist())) == {x: r for x, r in root.items() if x != r}
