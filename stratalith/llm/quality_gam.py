"""Quality classifier: a generalised additive model with pairwise interactions.

Every text gives a few numbers (shares of symbols, capitals, repeated words
and so on).  Each is cut into bins; boosting goes round the features, fits to
one at a time a shallow tree over its bins, and adds a small part of it to the
feature's table.  Then the pairs of features with the largest gain get tables
over both bins in the same way.  A score is the sum of one table entry for each
feature and pair.

The model is learnt on the driver from at most ``max_rows`` labelled documents
(numbers only, no texts); every document is scored, in Arrow batches.

Edge cases: a null or empty text has one line and no words, all its other
numbers are 0, and it gets a score like any other.  Without labels of both kinds every score is the share of label 1,
or 0.5.  Rows that repeat an id get a row each.  A very long text is a
block of its own and read as a whole.  An empty table of documents gives an
empty result.  Only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import prepare
from .labels import held_out, learning_rows

FEATURES = ("words", "word_bytes", "long_words", "short_words", "symbols", "marks", "capitals", "capital_words", "digits", "stops", "same_as_before", "distinct_words", "distinct_windows", "top_word", "lines", "line_words", "same_lines", "non_ascii")
THRESHOLD = 0.3


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_SYMBOL, _MARK, _CAPITAL, _DIGIT, _STOP, _LINE = (_kind(x) for x in (b"#*$%&|<>^~{}[]\\", b"!?", bytes(range(65, 91)), b"0123456789", b".,;:", b"\n"))
_HIGH = np.zeros(256, np.int32)
_HIGH[128:] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    def total(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(kind[data])])[offsets])

    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float32)
    starts, ends, first = textkit.words(data, offsets)
    count, size = np.diff(first), np.maximum(1, np.diff(offsets))
    some = np.maximum(1, count)
    length = ends - starts
    lower = textkit.LOWER[data]
    hashes = textkit.word_hashes(lower, starts, ends)
    inside = np.ones(len(hashes), bool)
    inside[first[:-1][count > 0]] = False

    def words(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[first]) / some

    capitals = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    before = np.zeros(len(hashes), bool)
    before[1:] = hashes[1:] == hashes[:-1]
    windows = textkit.windows(hashes, 5)
    for k in np.flatnonzero(count).tolist():
        own = np.sort(hashes[first[k] : first[k + 1]])
        runs = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        out[k, 11], out[k, 13] = (len(runs) - 1) / len(own), np.diff(runs).max() / len(own)
        if count[k] > 5:
            own = windows[first[k] : first[k + 1] - 4]
            out[k, 12] = len(np.unique(own)) / len(own)
        else:
            out[k, 12] = 1
    line = np.concatenate([np.sort(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1])), [len(data)]])
    lines_of = np.searchsorted(line[:-1], offsets[:-1], "left")
    lines = total(_LINE) + 1
    held = np.searchsorted(starts, line)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=sums[1:])
    line_hash = textkit.mix(sums[held[1:]] - sums[held[:-1]])
    for k in np.flatnonzero(lines > 1).tolist():
        own = line_hash[lines_of[k] : lines_of[k] + lines[k]]
        out[k, 16] = 1 - len(np.unique(own)) / len(own)
    out[:, 0], out[:, 1] = np.log1p(count), np.diff(np.concatenate([[0], np.cumsum(length)])[first]) / some
    out[:, 2], out[:, 3] = words(length > 24), words(length <= 3)
    for column, kind in ((4, _SYMBOL), (5, _MARK), (6, _CAPITAL), (8, _DIGIT), (9, _STOP), (17, _HIGH)):
        out[:, column] = total(kind) / size
    out[:, 7] = words(capitals[ends] - capitals[starts] > 0.5 * length)
    out[:, 10] = words(before & inside)
    out[:, 14], out[:, 15] = lines / some, count / lines
    return out


class AdditiveModel:
    """Bins, a table for each feature and for each chosen pair, and a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, smooth: float = 1.0):
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.constant, self.pairs = float(np.log(share / (1 - share))), []
        levels = np.linspace(0, 1, bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], levels)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.coarse = [c[np.linspace(0, len(c) - 1, min(len(c), pair_bins - 1)).astype(int)] if len(c) else c for c in self.cuts]
        if len(np.unique(y)) < 2:
            return
        at = self.binned(x, self.cuts)
        total = np.full(len(y), self.constant)
        for _ in range(rounds):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-total))
                step = rate * shallow(np.bincount(at[f], y - p, len(table)), np.bincount(at[f], p * (1 - p), len(table)), smooth)
                table += step
                total += step[at[f]]
        wide = self.binned(x, self.coarse)
        size = [len(c) + 1 for c in self.coarse]
        p = 1 / (1 + np.exp(-total))
        gain = []
        for a, b in combinations(range(x.shape[1]), 2):
            cell = wide[a] * size[b] + wide[b]
            g, h = (np.bincount(cell, v, size[a] * size[b]) for v in (y - p, p * (1 - p)))
            gain.append((-float((g * g / (h + smooth)).sum()), a, b))
        self.pairs = [(a, b, np.zeros(size[a] * size[b])) for _, a, b in sorted(gain)[:pairs]]
        for _ in range(pair_rounds):
            for a, b, table in self.pairs:
                cell = wide[a] * size[b] + wide[b]
                p = 1 / (1 + np.exp(-total))
                g, h = (np.bincount(cell, v, len(table)).reshape(size[a], size[b]) for v in (y - p, p * (1 - p)))
                # Depth two: one cut of the first feature, then a shallow tree over the second on either side.
                cut = best_cut(g.sum(1), h.sum(1), smooth)
                step = np.zeros_like(g)
                for side in (slice(0, cut), slice(cut, size[a])):
                    if g[side].size:
                        step[side] = shallow(g[side].sum(0), h[side].sum(0), smooth)
                step = rate * step.ravel()
                table += step
                total += step[cell]

    @staticmethod
    def binned(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for table, at in zip(self.tables, self.binned(x, self.cuts), strict=True):
            total += table[at]
        wide = self.binned(x, self.coarse)
        for a, b, table in self.pairs:
            total += table[wide[a] * (len(self.coarse[b]) + 1) + wide[b]]
        return 1 / (1 + np.exp(-total))


def best_cut(g: np.ndarray, h: np.ndarray, smooth: float) -> int:
    """Where to cut a row of bins in two: the first bin of the right part, len(g) for no cut."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + smooth) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + smooth)
    return int(np.argmax(gain)) + 1 if len(gain) and gain.max() > g.sum() ** 2 / (h.sum() + smooth) + 1e-9 else len(g)


def shallow(g: np.ndarray, h: np.ndarray, smooth: float, depth: int = 2) -> np.ndarray:
    """The Newton steps of a tree of this depth over ordered bins."""
    cut = best_cut(g, h, smooth) if depth else len(g)
    if cut in (0, len(g)):
        return np.full(len(g), g.sum() / (h.sum() + smooth))
    return np.concatenate([shallow(g[:cut], h[:cut], smooth, depth - 1), shallow(g[cut:], h[cut:], smooth, depth - 1)])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        rows = [features(data, offsets) for _, _, data, offsets in textkit.blocks(batch.column("text"))]
        yield batch, np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)), np.float32)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> AdditiveModel:
    """The model of labels.quality, from at most max_rows documents that are not held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _columns(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = learning_rows(docs, labels, "quality", max_rows).mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return AdditiveModel(x, rows.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _columns(batches):
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of docs, all columns as they are, that the model does not reject; docs needs a column text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _columns(batches):
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    prepare(docs.sparkSession)
    return score(docs, learn(docs, labels, max_rows))
