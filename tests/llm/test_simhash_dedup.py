"""SimHash fingerprints and links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalith.llm import simhash_dedup as S


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    nodes, parent = sorted(set(prints)), {p: p for p in prints}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return [least.get(root(p)) for p in prints]


def texts():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefßé") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    out = [None, "", " \n", "one", "ONE", "one two", "one two three", "One  two\tTHREE", "É é"]
    base = [rnd.choice(words) for _ in range(400)]
    for k in range(60):
        copy = list(base)
        for _ in range(k // 12):
            copy[rnd.randrange(400)] = rnd.choice(words)
        out.append(" ".join(copy))
    return out + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("crowd", [S.CROWD, 1])
def test_rows_equal_brute_force(spark, crowd):
    data = list(enumerate(texts()))
    rows = [*data, data[9], (None, data[9][1]), (None, "alone without an id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "component_id": F.lit(1)}).repartition(5)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip((r[0] for r in rows), (f"{p:016x}" for p in prints), plain_components([r[0] for r in rows], prints))))
    assert sorted(str(tuple(r)) for r in S.near_duplicates(docs, crowd).collect()) == want


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(t for t in texts() if t)
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "PIECE", 7)
    assert S.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_anchors_cover():
    rng = np.random.default_rng(4)
    x = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    of, home = S.anchors(x, 0)
    assert (of == np.arange(len(x))).all()  # one home each
    for flips in range(3):
        y = x.view(np.uint64).copy()
        for k in range(len(y)):
            for bit in rng.choice(64, flips, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(bit)
        of, at = S.anchors(y.view(np.int64))
        assert set(zip(range(len(x)), home.tolist())) <= set(zip(of.tolist(), at.tolist()))
    assert len(of) / len(x) < 70


@pytest.mark.parametrize("crowd", [S.CROWD, 3])
def test_links_of_crowds(spark, crowd):
    rnd = random.Random(9)
    prints = {0}
    for base in [rnd.getrandbits(64) for _ in range(4)]:
        for _ in range(150):  # chains and clouds around a few centres
            x = rnd.choice([base, *list(prints)[-5:]])
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    pairs = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in S.links(df, crowd).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in pairs)
    roots = {r["node"]: r["root"] for r in S.components(S.links(df, crowd)).collect()}
    ids = sorted(signed)
    want = plain_components(ids, [p & (2**64 - 1) for p in ids])
    assert [roots.get(p, p) for p in ids] == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
