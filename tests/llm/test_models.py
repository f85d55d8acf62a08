"""The learnt models against plain versions: sums of tables, noisy-or, and the gradient that teaches it."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from stratalith.llm import quality_gam as G
from stratalith.llm import textkit
from stratalith.llm import toxicity as T


def test_additive_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    m = G.AdditiveModel(x, y, rounds=30, pair_rounds=20)
    probe = np.concatenate([rng.normal(size=(50, 5)).astype(np.float32), x[:20], np.full((1, 5), 99, np.float32)])
    for row, got in zip(probe, m.score(probe)):
        total = m.constant
        for f, (cuts, table) in enumerate(zip(m.cuts, m.tables)):
            total += table[sum(row[f] >= c for c in cuts)]
        for a, b, table in m.pairs:
            total += table[sum(row[a] >= c for c in m.coarse[a]) * (len(m.coarse[b]) + 1) + sum(row[b] >= c for c in m.coarse[b])]
        assert math.isclose(got, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.9 and any({a, b} == {0, 1} for a, b, _ in m.pairs)


def test_best_cut_is_the_best_of_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        g, h = rng.normal(size=7), rng.uniform(0.1, 2, 7)
        def gain(k):
            return g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1)
        best = max(range(1, 7), key=gain)
        cut = G.best_cut(g, h, 1.0)
        assert cut == best or (cut == 7 and gain(best) <= g.sum() ** 2 / (h.sum() + 1) + 1e-9)


def plain_score(text, weights, heads, constant):
    """Sentences end behind . ! ? and newlines; a feature counts once in each."""
    none, part = 1.0, re.split(r"(?<=[.!?\n])", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if part and part[-1] == "":
        part.pop()
    for s in part:
        words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", s)
        z = constant + sum(weights.get(w, 0) for w in set(words)) + sum(heads.get(h, 0) for h in {w.encode()[:4] for w in words})
        none *= 1 - 1 / (1 + math.exp(-z))
    return 1 - none


def test_document_score_is_the_noisy_or_of_its_sentences():
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "alphorn", "x1", "be"]
    def hashes(tokens):
        data = " ".join(tokens).encode()
        arr = np.frombuffer(data, np.uint8)
        starts, ends, _ = textkit.words(arr, np.array([0, len(data)]))
        return textkit.word_hashes(arr, starts, ends), textkit.mix(textkit.word_hashes(arr, starts, np.minimum(ends, starts + T.HEAD)) ^ T._SALT)

    own, head = hashes(words)
    weights = {w: rnd.uniform(-2, 3) for w in words[:4]}
    heads = {w.encode()[:4]: rnd.uniform(-1, 2) for w in ("alpha", "x1")}
    table = {int(h): weights[w] for w, h in zip(words, own) if w in weights} | {int(h): heads[w.encode()[:4]] for w, h in zip(words, head) if w in ("alpha", "x1")}
    keys = np.array(sorted(table), np.uint64)
    model = T.SentenceModel(keys, np.array([table[int(k)] for k in keys]), -3.0)
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", ". ", "!\n", ", ", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(60)] + ["", "Alpha ALPHA alpha", "..."]
    scores, _, first = model.sentences(*textkit.flat(pa.array(texts)))
    got = T.noisy_or(scores, first)
    for t, s in zip(texts, got.tolist()):
        assert math.isclose(s, plain_score(t, weights, heads, -3.0), abs_tol=1e-9)


def test_learning_raises_the_likelihood_and_finds_the_sentence():
    rng = np.random.default_rng(6)
    n = 300
    y = (rng.random(n) < 0.3).astype(float)
    doc, sentence, feature = [], [], []
    for d in range(n):  # feature 0 stands in one sentence of each toxic document, 1 and 2 anywhere
        for s in range(3):
            own = [f for f in (1, 2) if rng.random() < 0.4] + ([0] if s == 1 and y[d] else [])
            if own:
                sentence += [len(doc)] * len(own)
                feature += own
                doc.append(d)
    doc, entries = np.array(doc), np.stack([sentence, feature])
    plain = 3.0 - np.bincount(doc, minlength=n)

    def loss(w, c):
        z = c + np.bincount(entries[0], w[entries[1]], len(doc))
        none = np.bincount(doc, np.logaddexp(0, z), n) + plain * np.logaddexp(0, c)
        return -np.where(y > 0, np.log(-np.expm1(-none)), -none).mean()

    w, c = T.fit(y, doc, entries, 3, plain)
    assert w[0] > 4 and w[0] > max(w[1], w[2]) + 3
    assert loss(w, c) < 0.05 < loss(np.ones(3), -6.0)
    short, more = T.fit(y, doc, entries, 3, plain, steps=20, decay=0), T.fit(y, doc, entries, 3, plain, steps=200, decay=0)
    assert loss(*more) < loss(*short)
    one = T.fit(y, doc, entries, 3, plain, steps=1, rate=1e-3, decay=0)  # the first step goes down each coordinate's slope
    start, eps = np.ones(3), 1e-5
    for k in range(3):
        slope = (loss(start + eps * np.eye(3)[k], -6.0) - loss(start - eps * np.eye(3)[k], -6.0)) / (2 * eps)
        assert np.sign(one[0][k] - 1) == -np.sign(slope)
