"""Ranked search against a plain count of terms."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratalith.llm import lexical_search as L


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    own = defaultdict(set)
    for i, t in items:
        own[i] |= set(terms(t))
    out = []
    for item, wanted in own.items():
        found = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in wanted if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(map(str, out))


def corpus():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeÄß9") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    def prose(n):
        return "".join(rnd.choice(words) + rnd.choice([" ", "-", "\n", ", ", "__", ". The "]) for _ in range(n))
    docs = [(i, prose(rnd.randint(0, 80))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " .,-\n"), (203, "THE"), (7, docs[7][1]), (7, "the the a"), (None, prose(30)), (None, docs[3][1]), (204, docs[3][1]), (205, "q" * 40000 + " the"), (206, prose(9000)), (207, "ab\x00ab\x7fÄb")]
    items = [(i, prose(rnd.randint(0, 30))) for i in range(25)] + [(3, prose(5)), (None, "the abc"), (90, None), (91, ""), (92, "notinanytext"), (93, docs[7][1]), (94, "Äb")]
    return docs, items


@pytest.mark.parametrize("block,top", [(L.BLOCK, 50), (40, 3)])
def test_equals_plain_counts(spark, block, top, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "score": F.lit("x")}).repartition(7)
    i = spark.createDataFrame(items, "item_id int, text string").withColumn("terms", F.lit(0)).repartition(3)
    got = L.search(d, i, top, block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(docs, items, top)


def test_best_drops_nothing():
    rnd = random.Random(1)
    rows = [(rnd.randrange(4), k, rnd.randrange(1, 30)) for k in range(3000)]
    best = L.Best(4, 5)
    import numpy as np
    for k in range(0, 3000, 100):
        item, doc, score = (np.array([r[c] for r in rows[k : k + 100]]) for c in range(3))
        keep = score >= best.least[item]
        best.add(item[keep], doc[keep], score[keep])
        best.parts = [best.ranked()]
    item, doc, score = best.ranked()
    want = [r for i in range(4) for r in sorted((x for x in rows if x[0] == i), key=lambda x: (-x[2], x[1]))[:5]]
    assert list(zip(item.tolist(), doc.tolist(), score.tolist())) == want


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert L.search(d, i).count() == 0
    assert L.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), i.limit(0)).count() == 0
    assert L.search(spark.createDataFrame([(1, " ")], "doc_id long, text string"), i).count() == 0
