"""Ranked lexical search by a scan of all documents with an Aho-Corasick automaton.

The terms of the items are patterns of one automaton, each between two guards.
A text's bytes are lower-cased and every byte that belongs to no term becomes a
guard, so the automaton's hits are exactly the text's terms, found in the text
itself; there is no index of documents.  An automaton's output is a term's
number, and a list for each term maps it to the items that have it.

The documents are read twice: once for the counts (documents, terms, document
frequencies), once for the scores.  Both times a task keeps counts of fixed
size: a number for each term, or the ``top`` best documents of each item.  What
tasks found is merged by sums and by ranks, the latter in two steps, so that no
task gets the finds of all others.

Items are taken in blocks of ``BLOCK`` terms (counted for each item), and the
documents are scanned for each block; that bounds the automaton, whatever the
number of items.  An item with more terms is a block of its own.  An item's
terms are never parted, so its scores are whole.

Edge cases: a null text has no terms and is no document; an item without terms
has no row.  Rows of items that share an item_id are one item with all their
terms; a null item_id is an item too.  Rows that repeat a doc_id are documents
of their own; of equal scores the smaller doc_id comes first, a null one last.
A very long text is scanned as a whole by the automaton, in one pass.  Empty
tables give an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .common import prepare, table

TOP = 50
#: Terms, counted for each item, in one automaton.
BLOCK = 1 << 18
#: Cells of documents by items that a task scores at once, and documents kept for an item before they are ranked.
CELLS, HELD = 1 << 20, 1 << 16
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GUARD = "\n"
_NULL = np.iinfo(np.int64).max

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[[k for k in range(128) if not chr(k).isalnum()]] = ord(GUARD)
FOLD = _fold.tobytes()

_built: dict[str, tuple[ahocorasick.Automaton, np.ndarray]] = {}


class Terms:
    """The terms of a block of items, with the items of each term; shipped to tasks, which build the automaton once."""

    def __init__(self, items: list, terms: list[list[str]]):
        self.name, self.items = uuid.uuid4().hex, items
        self.words = sorted({t for own in terms for t in own})
        number = {t: k for k, t in enumerate(self.words)}
        pairs = np.array([(number[t], i) for i, own in enumerate(terms) for t in set(own)], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.starts, self.of = np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1)), pairs[:, 1]

    def automaton(self) -> ahocorasick.Automaton:
        if self.name not in _built:
            _built.clear()
            found = ahocorasick.Automaton()
            for k, word in enumerate(self.words):
                found.add_word(GUARD + word.encode().decode("latin-1") + GUARD, k)
            found.make_automaton()
            _built[self.name] = found
        return _built[self.name]

    def counts(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """How many terms a text has, the numbers of those that the items have, and how often each occurs."""
        folded = text.translate(FOLD)
        data = np.frombuffer(folded, np.uint8) != ord(GUARD)
        n = int(data[:1].sum()) + int((data[1:] & ~data[:-1]).sum())
        hits = [k for _, k in self.automaton().iter(GUARD + folded.decode("latin-1") + GUARD)]
        return n, *np.unique(np.array(hits, np.int64), return_counts=True)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, sorted."""
    low = F.translate("text", "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[Terms]:
    """The items in blocks; the driver holds one block at a time."""
    now, terms, total = [], [], 0
    for row in item_terms(items).orderBy("item_id").toLocalIterator():
        if now and total + len(row["terms"]) > size:
            yield Terms(now, terms)
            now, terms, total = [], [], 0
        now.append(row["item_id"])
        terms.append(row["terms"])
        total += len(row["terms"])
    if now:
        yield Terms(now, terms)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        ids = batch.column(0).fill_null(_NULL).to_numpy()
        data, offsets = textkit.flat(batch.column(1))
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            yield int(ids[k]), data[a:b].tobytes()


def frequencies(docs: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and the number of documents that hold each of the block's terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, full, total = np.zeros(len(terms.words), np.int64), 0, 0
        for _, text in _texts(batches):
            n, which, _ = terms.counts(text)
            df[which] += 1
            full, total = full + (n > 0), total + n
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, [-1, -2])), pa.array(np.append(df[found], [full, total]))], ["term", "n"])

    sums = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(len(terms.words), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return int(n[at == -1].sum()), int(n[at == -2].sum()), df


class Best:
    """The best documents of each item so far, with the least score that still counts."""

    def __init__(self, items: int, top: int):
        self.top, self.least, self.parts = top, np.zeros(items, np.int64), []
        self.size = 0

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((item, doc, score))
        self.size += len(item)
        if self.size > max(HELD, 2 * self.top * len(self.least)):
            self.parts = [self.ranked()]
            self.size = len(self.parts[0][0])

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, doc, score = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in self.parts)]) for k in range(3))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        last = rank == self.top - 1
        self.least[item[last]] = score[last]  # lower ones never count again; equal ones may, by their id
        keep = rank < self.top
        return item[keep], doc[keep], score[keep]


def _scored(docs: DataFrame, terms: Terms, top: int) -> DataFrame:
    """item_id, doc_id, score, part: for each task its best documents of each item."""
    full, total, df = frequencies(docs, terms)
    weight = np.array([math.floor(1000 * math.log((2 * full + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast((terms, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (terms, weight), part = shipped.value, TaskContext.get().partitionId()
        items = len(terms.items)
        best, ids, held = Best(items, top), [], []
        room = max(1, CELLS // items)

        def take() -> None:
            sums = np.zeros((len(ids), items), np.int64)
            for row, (which, gain) in enumerate(held):  # each term's gain goes to all items that have it
                n = terms.starts[which + 1] - terms.starts[which]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(terms.starts[which], n)
                np.add.at(sums[row], terms.of[at], np.repeat(gain, n))
            row, item = np.nonzero((sums > 0) & (sums >= best.least))
            best.add(item, np.array(ids, np.int64)[row], sums[row, item])
            ids.clear()
            held.clear()

        for doc, text in _texts(batches):
            n, which, tf = terms.counts(text)
            if len(which):
                m = 50 + (50 * n * full) // total
                ids.append(doc)
                held.append((which, weight[which] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))))
                if len(ids) >= room:
                    take()
        if ids:
            take()
        item, doc, points = best.ranked()
        for k in range(0, len(item), 1 << 16):
            own, which, gain = (x[k : k + (1 << 16)] for x in (item, doc, points))
            yield pa.RecordBatch.from_arrays(
                [pa.array([terms.items[i] for i in own.tolist()], pa.int64()), pa.array(which, mask=which == _NULL), pa.array(gain), pa.array(np.full(len(own), part, np.int32))], ["item_id", "doc_id", "score", "part"])

    return docs.mapInArrow(score, "item_id long, doc_id long, score long, part int")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    block: terms in one automaton.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for terms in blocks(items, block):
        part = table(_scored(rows, terms, top), "scores")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    few = found.withColumn("n", F.row_number().over(Window.partitionBy("item_id", F.col("part") % 64).orderBy(*order))).where(F.col("n") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM d),
l AS (SELECT r, 50 + (50 * count(*) * (SELECT n_docs FROM s)) // (SELECT n_terms FROM s) AS m FROM d GROUP BY r),
t AS (SELECT r, doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term),
f AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t GROUP BY term),
p AS (SELECT item_id, r, t.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN f USING (term) JOIN l USING (r) GROUP BY item_id, r, t.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY rank <= 50
"""
