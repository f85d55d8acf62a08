"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's score is a logistic function of the words in it and of their
first four bytes; a document's score is the noisy-or of its sentences,
1 - product(1 - score).  Weights are learnt by gradient from document labels
alone, so a toxic document teaches through whichever sentence explains it.
The document frequencies that choose the features are counted by Spark over
the learning rows (at most ``max_rows``); the driver gets only the chosen
features (at most ``max_features``) and where they occur in learning rows.

Edge cases: a null or empty text has no sentences and scores 0.  Without
labels of both kinds no feature is chosen and every score is 0.  Rows that
repeat an id get a row each.  A very long text is a block of its own, all of its
sentences count.  An empty table of documents gives an empty result.  Only
doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import prepare, table
from .labels import held_out, learning_rows

THRESHOLD = 0.5
HEAD = 4
_SALT = np.uint64(0xA0761D6478BD642F)
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_WORD = np.ones(256, bool)
_WORD[:48] = _WORD[58:65] = _WORD[91:97] = _WORD[123:128] = False


def instances(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all texts' words: (word feature, head feature, sentence of each word), sentence bounds, first sentence of each text and one more."""
    low = textkit.LOWER[data]
    n = len(low)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:] |= _END[low] if n else False
    bounds = np.flatnonzero(cut)
    is_word = _WORD[low]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    words = textkit.word_hashes(low, starts, ends)
    heads = textkit.mix(textkit.word_hashes(low, starts, np.minimum(ends, starts + HEAD)) ^ _SALT)
    sentence = np.searchsorted(bounds, starts, "right") - 1
    return words, heads, sentence, bounds, np.searchsorted(bounds, offsets)


class SentenceModel:
    """Sorted features with their weights, and the weight that every sentence has."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, constant: float):
        self.keys, self.weights, self.constant = keys, weights, constant

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are features, and which features."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        return hit, at[hit]

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all sentences, their bounds, and the first sentence of each text and one more."""
        words, heads, sentence, bounds, first = instances(data, offsets)
        z = np.full(max(0, len(bounds) - 1), self.constant)
        for hashes in (words, heads):
            hit, feature = self.find(hashes)
            # A feature counts once in a sentence.
            pair = np.unique(sentence[hit] * np.int64(max(1, len(self.keys))) + feature)
            np.add.at(z, pair // max(1, len(self.keys)), self.weights[pair % max(1, len(self.keys))])
        return 1 / (1 + np.exp(-z)), bounds, first


def noisy_or(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - product(1 - score) of the sentences of each text."""
    logs = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(scores, 1 - 1e-12)))])
    return np.clip(1 - np.exp(logs[first[1:]] - logs[first[:-1]]), 0, 1)


def fit(y: np.ndarray, doc: np.ndarray, entries: np.ndarray, features: int, plain: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and constant by Adam on the likelihood of the documents' labels.

    doc: the document of each sentence that has a feature; entries: (sentence,
    feature) pairs; plain: how many sentences without features each document has.
    """
    w = np.zeros(features + 1)
    w[-1] = -6.0  # few sentences are toxic
    m, v = np.zeros_like(w), np.zeros_like(w)
    sentence, feature = entries
    w[:-1][np.bincount(feature, minlength=features) > 0] = 1.0
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(sentence, w[feature], len(doc))
        s, s0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        none = np.bincount(doc, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, w[-1])
        none = np.maximum(none, 1e-9)
        pull = np.where(y > 0, np.exp(-none) / -np.expm1(-none), -1.0)
        by_sentence = s * pull[doc]
        grad = np.append(np.bincount(feature, by_sentence[sentence], features), by_sentence.sum() + s0 * (pull * plain).sum()) / len(y)
        grad[:-1] -= decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 4096, least_docs: int = 4) -> SentenceModel:
    """The model of labels.toxic, from at most max_rows documents that are not held out."""
    rows = table(learning_rows(docs, labels, "toxic", max_rows), "toxic")
    counts = {r["y"]: r["count"] for r in rows.groupBy(F.when(F.col("y") > 0, 1).otherwise(0).alias("y")).count().collect()}
    if len(counts) < 2:
        return SentenceModel(np.zeros(0, np.uint64), np.zeros(0), -40.0)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for first, last, data, offsets in textkit.blocks(batch.column("text")):
                words, heads, sentence, _, starts = instances(data, offsets)
                doc = np.searchsorted(starts, sentence, "right") - 1
                for hashes in (words, heads):
                    order = np.lexsort((hashes, doc))
                    d, h = doc[order], hashes[order]
                    new = np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))[: len(d)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array((y[first:last][d[new]] > 0).astype(np.int64))], ["h", "y"])

    n1, n0 = counts[1], counts[0]
    seen = rows.mapInArrow(distinct, "h long, y long").groupBy("h").agg(F.sum("y").alias("a"), F.count("*").alias("n")).where(F.col("n") >= least_docs)
    rate = (F.col("a") / n1) / ((F.col("n") - F.col("a") + 0.5) / n0)
    chosen = seen.where(rate > 2).orderBy((F.col("a") * F.log(rate)).desc(), "h").limit(max_features).select("h").toArrow()
    keys = np.sort(chosen.column("h").to_numpy().view(np.uint64))
    model = SentenceModel(keys, np.zeros(len(keys)), 0.0)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, ids = batch.column("y").to_numpy(), batch.column("doc_id").to_numpy()
            for first, last, data, offsets in textkit.blocks(batch.column("text")):
                words, heads, sentence, bounds, starts = instances(data, offsets)
                pairs = []
                for hashes in (words, heads):
                    hit, feature = model.find(hashes)
                    pairs.append(np.stack([sentence[hit], feature]))
                pair = np.unique(np.concatenate(pairs, axis=1), axis=1)
                doc = np.searchsorted(starts, pair[0], "right") - 1
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:last]), pa.array((y[first:last] > 0).astype(np.int64)), pa.array(np.diff(starts)),
                     pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(pair[0] - starts[doc])), pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(pair[1]))],
                    ["doc_id", "y", "n", "sentence", "feature"])

    got = rows.mapInArrow(found, "doc_id long, y long, n long, sentence array<long>, feature array<long>").toArrow().sort_by("doc_id")
    y, n = got.column("y").to_numpy().astype(np.float64), got.column("n").to_numpy()
    sizes = np.array([len(x) for x in got.column("feature").to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(y)), sizes)
    sentence = np.array([s for x in got.column("sentence").to_pylist() for s in x], np.int64)
    feature = np.array([f for x in got.column("feature").to_pylist() for f in x], np.int64)
    key, at = np.unique(doc * np.int64(1 << 32) + sentence, return_inverse=True)
    doc = key >> 32
    weights, constant = fit(y, doc, np.stack([at, feature]), len(keys), n - np.bincount(doc, minlength=len(y)))
    return SentenceModel(keys, weights, constant)


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_sentences and the offending sentences (start, end in characters, score) of every row."""
    prepare(docs.sparkSession)
    model = learn(docs, labels, max_rows)
    schema = "doc_id long, held_out boolean, score double, predicted int, n_toxic_sentences int, sentences array<struct<start: long, end: long, score: double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textkit.blocks(batch.column("text")):
                scores, bounds, starts = model.sentences(data, offsets)
                p = noisy_or(scores, starts)
                bad = np.flatnonzero(scores >= THRESHOLD)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                doc = np.searchsorted(starts, bad, "right") - 1
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                base = chars[offsets[doc]]
                spans = pa.StructArray.from_arrays([pa.array(chars[bounds[bad]] - base), pa.array(chars[bounds[bad + 1]] - base), pa.array(scores[bad])], ["start", "end", "score"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("held_out").slice(first, last - first), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)),
                     pa.array(np.diff(cut).astype(np.int32)), pa.ListArray.from_arrays(cut.astype(np.int32), spans)],
                    ["doc_id", "held_out", "score", "predicted", "n_toxic_sentences", "sentences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, schema)
