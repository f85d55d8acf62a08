"""Substring deduplication: paragraph MinHash banding, exact verification, removal by components.

A passage that two documents share rarely begins and ends with a line, so
lines count for nothing: a newline is a blank like others, and paragraphs are
runs of words.  There are two kinds of them:

* Short ones overlap: every ``WINDOW`` five-word shingles in a row are a
  paragraph, with one MinHash value, the least of its shingles, as its only band.
  Paragraphs beside each other mostly share that shingle, so a text has one of
  these seeds for some six words.  A seed that two documents share is
  verified by the word edit distance of what stands around it: to either side of
  the seed, up to ``SIDE`` words, a banded alignment goes as far as four words
  in five agree, and both together must have ``min_words`` words.  So a passage
  of sixty words is found with two or three of its words altered, wherever
  they stand, and what is removed ends where the texts part.
* Blocks, unless switched off: a text is cut before every word whose hash is the least among its
  ``RADIUS`` neighbours on either side and among ``BLOCK_RADIUS`` of them for
  blocks, some fifty words (of equal words the first, and never at a word that
  only repeats the one before).  Blocks get MinHash bands over their five-word
  shingles, tuned to the recall asked for, and are verified by their exact
  Jaccard similarity, so that blocks are found, too, that agree by their
  shingles but not in their order.

What is verified is linked, and links are closed to components; a component
that lies in two or more documents is repeated.  The document with the least id
keeps it, from all later ones it is removed.

Which seeds of a crowd are compared: all surroundings of a seed, each distinct
one once, are sorted by the words to its right, and each is aligned with the one
before it.  Those alike in a row are a chain; the first of each chain are sorted
again by the words to the left.  Copies of a passage stand together in at
least one of the orders unless they differ on both sides, and then other seeds
link them.  That is linear in the size of a crowd, and a crowd is spread over
many tasks.  Band values of blocks that are crowded are compared with one of
their blocks, and what is still apart exactly, in blocks of bounded size.

Edge cases: null and empty texts have no paragraphs.  Rows that repeat a
doc_id are one document and do not repeat each other, though each text has its
own passages; rows with a null doc_id are not looked at.  A very long text is
a batch of its own.  A word or gap of more than 255 characters ends what is
compared around a seed.  Ties: of equal shingles in a window the first is the seed.
An empty table gives an empty result.  Columns other than doc_id and text are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import IdFilter, fresh, prepare, table
from .near_dedup import closed

WORDS, PERCENT, RADIUS, BLOCK_RADIUS, MIN_WORDS, RECALL = 5, 80, 4, 24, 22, 0.99
CROWD = 16  # blocks of a band value, up to which each is paired with each
WINDOW, SIDE, SHIFT = 12, 16, 2  # shingles of a short paragraph; words beside a seed; words that one side may run ahead
GATHER, PARTS = 1 << 20, 11  # keys that a task sorts together; bits of a key by which they are dealt
COST = 5  # of an altered word in words, so that one in five may be altered
PASSAGES = "doc_id long, text_key long, start long, end long, n_words long, n_removed_words long, removed boolean, clusters array<long>, cuts array<struct<start: long, end: long>>"
#: A paragraph of a text that may repeat.  Seeds have a key, a name of what is around them, the number of words before them there, and bytes with each word's length
#: and gap; blocks have the keys of their bands, a fingerprint and their shingles.
HIT = "doc_id long, text_key long, start long, end long, first_word long, last_word long, key long, around long, at int, steps binary, keys array<long>, fp long, shingles array<long>"
_rng = np.random.Generator(np.random.PCG64(11))
_FACTOR = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)


def tune_bands(percent: int = PERCENT, recall: float = RECALL, unlike: int = 20, chance: float = 0.1, most: int = 256) -> tuple[int, int]:
    """(bands, rows of a band): the fewest hashes that find a pair at the threshold with this recall, and one at ``unlike`` percent with this chance at most."""
    def met(j: float, bands: int, rows: int) -> float:
        return 1 - (1 - (j / 100) ** rows) ** bands

    fit = [(b * r, b, r) for r in range(1, 17) for b in range(1, most // r + 1) if met(percent, b, r) >= recall and met(unlike, b, r) <= chance]
    if not fit:
        raise ValueError("no banding within the given number of hashes has this recall")
    return min(fit)[1:]


class Paragraphs:
    """The seeds and blocks of a batch of texts, as ranges of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = textkit.LOWER[data]
        self.starts, self.ends, self.first = textkit.words(low, offsets)
        n = len(self.starts)
        self.hashes = textkit.word_hashes(low, self.starts, self.ends)
        self.chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.offsets = offsets
        self.power, self.inverse = textkit._power(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * self.power[:n], out=self.sums[1:])
        self.shingles = textkit.windows(self.hashes, WORDS)

    @cached_property
    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first words of pieces and those of blocks; worked out only where they are asked for."""
        n = len(self.starts)
        doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        never = np.uint64(0xFFFFFFFFFFFFFFFF)
        value = self.hashes.copy()  # that a word is cut by: one that repeats the word before it is never least
        value[1:][(self.hashes[1:] == self.hashes[:-1]) & (doc[1:] == doc[:-1])] = never
        least = value != never
        for k in range(1, min(RADIUS, n - 1) + 1):
            apart = doc[k:] != doc[:-k]
            least[k:] &= apart | (value[k:] < value[:-k])
            least[:-k] &= apart | (value[:-k] <= value[k:])  # of equal words the first
        least[self.first[:-1][np.diff(self.first) > 0]] = True
        begin = np.flatnonzero(least)
        doc = doc[begin]
        wide = np.ones(len(begin), bool)  # of cuts, which are least among more neighbours
        for k in range(RADIUS + 1, BLOCK_RADIUS + 1):
            for other, tie in ((begin - k, False), (begin + k, True)):
                inside = (other >= self.first[doc]) & (other < self.first[doc + 1])
                mine, its = value[begin[inside]], value[other[inside]]
                wide[inside] &= (mine < its) | (tie & (mine == its))
        wide[np.append(True, doc[1:] != doc[:-1])[: len(wide)]] = True
        return begin, begin[wide]

    def _behind(self, begin: np.ndarray) -> np.ndarray:
        return np.append(begin[1:], len(self.starts)) if len(self.starts) else begin

    @property
    def begin(self) -> np.ndarray:
        return self.cuts[0]

    @property
    def end(self) -> np.ndarray:
        return self._behind(self.begin)

    @property
    def size(self) -> np.ndarray:
        return self.end - self.begin

    def named(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of the words of each range."""
        return textkit.mix((self.sums[last] - self.sums[first]) * self.inverse[first] + (last - first).astype(np.uint64))

    def spans(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, first and last character, and first and last word within the text, of each range."""
        doc = np.searchsorted(self.first, first, "right") - 1
        base = self.chars[self.offsets[doc]]
        return doc, self.chars[self.starts[first]] - base, self.chars[self.ends[last - 1]] - base, first - self.first[doc], last - self.first[doc]

    def seeds(self) -> np.ndarray:
        """The words at which the least shingle of some WINDOW shingles in a row begins."""
        n = len(self.starts)
        ends = np.repeat(self.first[1:], np.diff(self.first))  # behind the last word of each word's text
        windows = n - WORDS - WINDOW + 2
        if windows <= 0:
            return np.zeros(0, np.int64)
        value, least = self.shingles, self.shingles[:windows].copy()
        for k in range(1, WINDOW):
            np.minimum(least, value[k : windows + k], out=least)
        free = np.arange(windows) + WORDS + WINDOW - 1 <= ends[:windows]
        chosen = np.zeros(len(value), bool)
        for k in range(WINDOW):
            hit = free & (value[k : windows + k] == least)
            chosen[k : windows + k] |= hit
            free &= ~hit
        return np.flatnonzero(chosen)

    def around(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The seeds that no long word or gap parts, and the first and last word of what is compared around each."""
        doc = np.searchsorted(self.first, seeds, "right") - 1
        first, last = np.maximum(self.first[doc], seeds - SIDE), np.minimum(self.first[doc + 1], seeds + WORDS + SIDE)
        at, to = self.chars[self.starts], self.chars[self.ends]
        gap = np.append(0, at[1:] - to[:-1]) if len(at) else at
        wide = np.flatnonzero(to - at > 255)  # words that nothing reaches over, and gaps likewise
        far = np.flatnonzero(gap > 255)
        for stops, step in ((wide, 1), (far, 0)):
            if len(stops):
                k = np.searchsorted(stops, seeds + (1 - step), "left")  # the first stop in or behind the seed
                before = np.where(k > 0, stops[np.maximum(k - 1, 0)] + step, 0)
                behind = np.where(k < len(stops), stops[np.minimum(k, len(stops) - 1)], len(at))
                first, last = np.maximum(first, before), np.minimum(last, behind)
        whole = last >= seeds + WORDS
        return seeds[whole], first[whole], last[whole]

    def steps(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """For each range the lengths of its words, a byte each, and then, unless all are 1, their gaps to the word before."""
        at, to = self.chars[self.starts], self.chars[self.ends]
        size = last - first
        row, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        word = first[row] - begin[row] + np.arange(len(row))
        gap = (np.append(0, at[1:] - to[:-1]) if len(at) else at)[word]
        gap[begin[size > 0]] = 1  # lies before the range
        odd = np.zeros(len(size), bool)
        odd[row[gap != 1]] = True
        offsets = np.concatenate([[0], np.cumsum(size * (1 + odd))])
        place = offsets[row] - begin[row] + np.arange(len(row))
        out, more = np.empty(offsets[-1], np.uint8), odd[row]
        out[place] = (to - at)[word]
        out[place[more] + size[row[more]]] = gap[more]
        return _bytes(out, offsets)

    def sides(self, seeds: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Four bytes for each of the SIDE words to the left of each seed, the nearest first, and to its right; zeros where there is none."""
        short = (self.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        out = []
        for step in (-1, 1):
            at = (seeds - 1 if step < 0 else seeds + WORDS)[:, None] + step * np.arange(SIDE)
            inside = (at >= first[:, None]) & (at < last[:, None])
            words = np.where(inside, short[np.clip(at, 0, len(short) - 1)] if len(short) else 0, 0).astype(">u4")
            out.append(_bytes(np.ascontiguousarray(words), np.arange(len(seeds) + 1) * 4 * SIDE))
        return tuple(out)

    def blocks(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of min_words words or more, and of enough words for a shingle."""
        begin = self.cuts[1]
        end = self._behind(begin)
        long = end - begin >= max(min_words, WORDS)
        return begin[long], end[long]

    def bands(self, first: np.ndarray, last: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """A key for each band (axis 0) of each range."""
        out = np.zeros((bands, len(first)), np.uint64)
        if not len(first):
            return out
        bounds = np.stack([first, last - WORDS + 1], axis=1).ravel()
        for b in range(bands):
            for r in range(rows):
                h = b * rows + r
                values = np.append(self.shingles * _FACTOR[h] + _ADD[h], np.uint64(0))
                out[b] = textkit.mix(out[b] ^ np.minimum.reduceat(values, bounds)[::2])
            out[b] = textkit.mix(out[b] + np.uint64(b))
        return out

    def sets(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The sorted distinct shingles of each range."""
        size = last - first - WORDS + 1
        row = np.repeat(np.arange(len(first)), size)
        values = self.shingles[np.repeat(first - np.cumsum(size) + size, size) + np.arange(len(row))]
        order = np.lexsort((values, row))
        row, values = row[order], values[order]
        new = np.append(True, (row[1:] != row[:-1]) | (values[1:] != values[:-1]))[: len(row)]
        at = np.searchsorted(row[new], np.arange(len(first) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(at, pa.array(values[new].view(np.int64)))


SEED, BAND = np.uint64(0), np.uint64(1)


def _bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _kind(keys: np.ndarray, kind: np.uint64) -> np.ndarray:
    """Keys with their kind as the last bit."""
    return ((keys & ~np.uint64(1)) | kind).view(np.int64)


def _named(batches: Iterator[pa.RecordBatch], bands: int, rows: int, min_words: int, blocks: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """key and id of all seeds and bands, a run of texts at a time; id is a seed's document or a band's block."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for first, last, data, offsets in textkit.blocks(batch.column("text")):
            p = Paragraphs(data, offsets)
            at = p.seeds()
            doc, key = np.searchsorted(p.first, at, "right") - 1, _kind(p.shingles[at], SEED)
            yield key, ids[first:last][doc]
            if not blocks:
                continue
            a, b = p.blocks(min_words)
            once = np.sort(np.unique(p.named(a, b), return_index=True)[1])  # bands() takes ranges in their order
            a, b = a[once], b[once]
            fp, keys = p.named(a, b).view(np.int64), p.bands(a, b, bands, rows)
            yield _kind(keys.ravel(), BAND), np.tile(fp, bands)


def _keys(docs: DataFrame, bands: int, rows: int, min_words: int, blocks: bool = True) -> DataFrame:
    """(key, id) of all seeds and bands, a row each; see _named."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, id_ in _named(batches, bands, rows, min_words, blocks):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(id_)], ["key", "id"])

    return docs.mapInArrow(run, "key long, id long")


def extremes(key: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with its least id, and once more with its greatest if that is another; sorted by key as an unsigned number."""
    order = np.lexsort((id_, key.view(np.uint64)))
    key, id_ = key[order], id_[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    last = np.append(new[1:], True)[: len(key)]
    begin = np.flatnonzero(new)
    other = np.zeros(len(key), bool)
    other[last] = id_[last] != id_[begin]
    keep = new | other
    return key[keep], id_[keep]


def _shared(docs: DataFrame, bands: int, rows: int, min_words: int, blocks: bool = True) -> DataFrame:
    """key: the keys of _keys that have two ids.

    Most keys have one, and a row for each costs more than all else; so tasks sort some GATHER of them, keep two ids of each at most, and send them
    in ranges of keys, as bytes.
    """
    def packed(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, id_ = extremes(*(np.concatenate(x) for x in zip(*some)))
        part, begin = np.unique(key.view(np.uint64) >> np.uint64(64 - PARTS), return_index=True)
        offsets = np.append(begin, len(key)) * 8
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), _bytes(key, offsets), _bytes(id_, offsets)], ["part", "keys", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for pair in _named(batches, bands, rows, min_words, blocks):
            some.append(pair)
            n += len(pair[0])
            if n >= GATHER:
                yield packed(some)
                some, n = [], 0
        if n:
            yield packed(some)

    def met(part: pa.Table) -> pa.Table:
        key, _ = extremes(*(textkit.flat(part.column(c))[0].view(np.int64) for c in ("keys", "ids")))
        return pa.table({"key": key[1:][key[1:] == key[:-1]]})

    return docs.mapInArrow(run, "part int, keys binary, ids binary").groupBy("part").applyInArrow(met, "key long")


def _hits(docs: DataFrame, shared: DataFrame, bands: int, rows: int, min_words: int, blocks: bool = True) -> DataFrame:
    """The seeds and blocks that have a key in shared, and a few others; see HIT."""
    wanted = IdFilter(shared.select("key"))
    names = [x.split()[0] for x in HIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textkit.blocks(batch.column("text")):
                p, some = Paragraphs(data, offsets), batch.slice(first, last - first)

                def places(a: np.ndarray, b: np.ndarray, p: Paragraphs = p, some: pa.RecordBatch = some) -> list[pa.Array]:
                    doc, *span = p.spans(a, b)
                    return [some.column(c).take(pa.array(doc)) for c in ("doc_id", "text_key")] + [pa.array(x) for x in span]

                at = p.seeds()
                at, a, b = p.around(at[wanted.has(_kind(p.shingles[at], SEED))])
                key = _kind(p.shingles[at], SEED)
                nulls = [pa.nulls(len(at), kind) for kind in (pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*places(a, b), pa.array(key), pa.array(_around(p, at, a, b)), pa.array((at - a).astype(np.int32)), p.steps(a, b), *nulls], names)
                if not blocks:
                    continue
                a, b = p.blocks(min_words)
                keys = _kind(p.bands(a, b, bands, rows), BAND)
                hit = wanted.has(keys.ravel()).reshape(keys.shape)
                some_hit = hit.any(0)
                a, b, keys, hit = a[some_hit], b[some_hit], keys[:, some_hit], hit[:, some_hit]
                at = np.concatenate([[0], np.cumsum(hit.sum(0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, pa.array(keys.T[hit.T]))
                yield pa.RecordBatch.from_arrays([*places(a, b), *(pa.nulls(len(a), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.binary())), lists, pa.array(p.named(a, b).view(np.int64)), p.sets(a, b)], names)

    return docs.mapInArrow(run, HIT)


def _around(p: Paragraphs, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A name for the words around each seed and its place in them."""
    return textkit.mix(p.named(first, last) + (at - first).astype(np.uint64) * textkit._STEP).view(np.int64)


def reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each row of a and of b are aligned from the first on, so that the words gained less COST for each edit are most.

    Zeros are no words.  One row may run ahead of the other by SHIFT words.
    """
    n, size = a.shape
    far = np.int16(99)
    best, left, right = np.zeros(n, np.int16), np.zeros(n, np.int64), np.zeros(n, np.int64)
    before = {d: np.full(n, abs(d), np.int16) for d in range(-SHIFT, SHIFT + 1)}  # edits for no word of a and d words of b
    for i in range(1, size + 1):
        now: dict[int, np.ndarray] = {}
        for d in range(-SHIFT, SHIFT + 1):
            j = i + d
            if j < 0 or j > size:
                continue
            cost = before.get(d + 1, far) + np.int16(1)
            if d - 1 in now:
                cost = np.minimum(cost, now[d - 1] + np.int16(1))
            if j and d in before:
                same = (a[:, i - 1] == b[:, j - 1]) & (a[:, i - 1] != 0)
                cost = np.minimum(cost, before[d] + ~same)
            now[d] = np.broadcast_to(cost, (n,)).astype(np.int16)
            gain = max(i, j) - COST * now[d]
            more = gain > best
            best, left, right = np.where(more, gain, best), np.where(more, i, left), np.where(more, j, right)
        before = now
    return left, right


#: One of the surroundings of a seed: the first of the chain that it stands in, how many words on either side it shares, and, if it is the first itself, its words.
CHAINED = "key long, around long, head long, left_n long, right_n long, left binary, right binary"


def _chained(rows: DataFrame, by: str, min_words: int) -> DataFrame:
    """Sorts the surroundings of each seed (key, around, left, right) by one side and aligns each with the one before it; those alike in a row are a chain.  See CHAINED."""
    sort = ["key", by, "around"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first = None  # of the chain that the held row is in
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, now]) if held is not None else now).combine_chunks()
            old = int(held is not None)
            held = rows.slice(rows.num_rows - 1)
            key, name = rows.column("key").to_numpy(), rows.column("around").to_numpy()
            left, right = (np.frombuffer(textkit.flat(rows.column(c))[0], ">u4").reshape(-1, SIDE).astype(np.uint32) for c in ("left", "right"))
            i = np.flatnonzero(key[:-1] == key[1:])
            (la, lb), (ra, rb) = reach(left[i], left[i + 1]), reach(right[i], right[i + 1])
            good = np.minimum(la + ra, lb + rb) + WORDS >= min_words
            i, la, lb, ra, rb = (x[good] for x in (i, la, lb, ra, rb))
            n_left, n_right = np.zeros((2, len(name)), np.int64)
            n_left[i + 1], n_right[i + 1] = lb, rb
            n_left[i], n_right[i] = np.maximum(n_left[i], la), np.maximum(n_right[i], ra)
            starts = np.ones(len(name), bool)
            starts[i + 1] = False
            head = name[np.maximum.accumulate(np.where(starts, np.arange(len(name)), 0))]
            if old:  # what goes on from the batch before
                more = int(np.argmax(starts[1:])) + 1 if starts[1:].any() else len(name)
                head[:more] = first
            first = head[-1]
            back = old if old and not n_left[0] + n_right[0] else 0  # the held row again only if it shares more now
            starts[:old] = False  # its words have been given
            words = [pc.if_else(pa.array(starts), rows.column(c).combine_chunks(), None) for c in ("left", "right")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, name, head, n_left, n_right)] + words, [x.split()[0] for x in CHAINED.split(", ")]).slice(back)

    return rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("key", "around", "left", "right").mapInArrow(align, CHAINED)


def _alike(nodes: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """around, root, left, right: surroundings (see _around) of a seed that are like others, a name that alike ones share, and how many words on either side repeat.

    nodes: around and key, each once.  Every one has a chain by the words to the right, and that chain's head one by the words to the left,
    whose head is the root: two steps, so nothing is left to close.
    """
    crowded = nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    some = table(nodes.join(crowded, "key").select("around", "key"), "compared")
    wanted = IdFilter(some.select("around"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in textkit.blocks(batch.column(0)):
                p = Paragraphs(data, offsets)
                at, first, last = p.around(p.seeds())
                name = _around(p, at, first, last)
                _, once = np.unique(name, return_index=True)
                once = once[wanted.has(name[once])]
                left, right = p.sides(at[once], first[once], last[once])
                yield pa.RecordBatch.from_arrays([pa.array(name[once]), left, right], ["around", "left", "right"])

    words = docs.select("text").mapInArrow(gather, "around long, left binary, right binary")
    words = words.join(some, "around").dropDuplicates(["around"])
    by_right = table(_chained(words, "right", min_words), "chains")
    heads = by_right.where("left is not null").select("key", "around", "left", "right")

    def once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("around").agg(F.min("head").alias("head"), F.max("left_n").alias("left"), F.max("right_n").alias("right"))

    by_left = table(once(_chained(heads, "left", min_words)).select(F.col("around").alias("head"), F.col("head").alias("root"), F.col("left").alias("left_n"), F.col("right").alias("right_n")), "heads")
    own = F.col("around") == F.col("head")
    both = once(by_right).join(by_left, "head").select("around", "root", *(F.greatest(c, F.when(own, F.col(f"{c}_n"))).alias(c) for c in ("left", "right")))
    return both.where("left + right > 0")


def _repeated(hits: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """around, at, cluster, low (the least document of the cluster), and left and right, the words beside a seed that repeat."""
    words = F.col("last_word") - F.col("first_word")
    nodes = table(hits.where("key is not null").groupBy("around", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("at").cast("long").alias("at"), F.min(words).alias("words")), "seeds")
    linked = table(_alike(nodes, docs, min_words), "alike")
    whole = (F.col("low") < F.col("high")) & (F.col("words") >= min_words)  # the same words around it in two documents
    all_ = nodes.join(linked, "around", "left").where(whole | F.col("root").isNotNull()).select(
        "around", F.coalesce("root", "around").alias("cluster"), "low", "high", F.when(whole, F.col("at")).otherwise(F.col("left")).alias("left"),
        F.when(whole, F.col("words") - F.col("at") - WORDS).otherwise(F.col("right")).alias("right"))
    all_ = table(all_, "nodes")
    lies = all_.groupBy("cluster").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min("around").alias("name")).where("least < most").select("cluster", "least", "name")
    return table(all_.join(lies, "cluster").select("around", F.col("name").alias("cluster"), F.col("least").alias("low"), "left", "right"), "repeated")


def _spans(seeds: DataFrame) -> DataFrame:
    """The spans of repeated seeds: doc_id, text_key, start, end, first_word, last_word, cluster, goes."""
    schema = "doc_id long, text_key long, start long, end long, first_word long, last_word long, cluster long, goes boolean"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.flat(batch.column("steps"))
            start, first, last, at, left, right = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "first_word", "last_word", "at", "left", "right"))
            begin, end = at - left, at + WORDS + right  # words from the first one of the surroundings
            size = last - first
            row, zero = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            place = offsets[row] - zero[row] + np.arange(len(row))
            length, gap, odd = data[place].astype(np.int64), np.ones(len(row), np.int64), (np.diff(offsets) > size)[row]
            gap[odd] = data[place[odd] + size[row[odd]]]
            behind = np.cumsum(length + gap)  # each word's end
            ahead = behind - length
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(start + ahead[zero + begin] - ahead[zero]), pa.array(start + behind[zero + end - 1] - ahead[zero]),
                 pa.array(first + begin), pa.array(first + end), batch.column("cluster"), batch.column("goes")], [x.split()[0] for x in schema.split(", ")])

    return seeds.mapInArrow(place, schema)


def _near_blocks(hits: DataFrame, percent: int) -> DataFrame:
    """node (the fp of a block) and root of all blocks that are linked."""
    blocks = hits.where("fp is not null")
    met = table(blocks.select("fp", F.explode("keys").alias("key")).distinct(), "met")
    counts = table(met.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lead")).where("n > 1"), "counts")
    met = table(met.join(counts, "key"), "colliding")
    few = met.where(F.col("n") <= CROWD)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a > b").select("a", "b")
    many = met.where(F.col("n") > CROWD)
    pairs = pairs.union(many.where("fp <> lead").select(F.greatest("fp", "lead").alias("a"), F.least("fp", "lead").alias("b")))
    sets = table(blocks.select("fp", "shingles").groupBy("fp").agg(F.first("shingles").alias("shingles")).withColumnRenamed("fp", "doc_id"), "sets")
    sizes = sets.select(F.col("doc_id").alias("fp"), F.size("shingles").cast("long").alias("size"))
    members = table(many.join(sizes, "fp").select(F.col("fp").alias("rep"), F.col("key").alias("lead"), F.lit(0).alias("tree"), "size"), "crowded")
    return closed(table(pairs.distinct(), "pairs"), members, lambda ids: sets, percent)


def _changes(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The rows, but for the first, at which another text (the first two columns) begins."""
    doc, text = (rows.column(k).to_numpy() for k in (0, 1))
    return np.flatnonzero((doc[1:] != doc[:-1]) | (text[1:] != text[:-1])) + 1


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in runs of whole texts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _changes(batch)
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in (0, 1)):
            ends = np.append(0, ends)
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, ends[-1])])
            held, batch = [], batch.slice(ends[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _passages(docs: DataFrame, percent: int, recall: float, min_words: int, blocks: bool) -> DataFrame:
    """See PASSAGES; text_key tells the texts of a doc_id apart."""
    prepare(docs.sparkSession)
    bands, rows = tune_bands(percent, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key")).where("doc_id is not null")
    shared = table(_shared(docs, bands, rows, min_words, blocks), "shared")
    hits = table(_hits(docs, shared, bands, rows, min_words, blocks), "hits")
    span = ["doc_id", "text_key", "start", "end", "first_word", "last_word"]
    seeds = hits.where("key is not null").select("doc_id", "text_key", "start", "first_word", "last_word", "at", "steps", "around").join(_repeated(hits, docs, min_words), "around")
    runs = _spans(seeds.withColumn("goes", F.col("doc_id") > F.col("low"))).withColumn("near", F.lit(False))
    if blocks:
        near = hits.where("fp is not null").select(*span, "fp").join(_near_blocks(hits, percent).withColumnRenamed("node", "fp"), "fp")
        lies = near.groupBy("root").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
        runs = runs.union(near.join(table(lies, "lies"), "root").select(*span, F.col("root").alias("cluster"), (F.col("doc_id") > F.col("low")).alias("goes"), F.lit(True).alias("near")))
    text = ["doc_id", "text_key"]
    found = runs.select(*text, "first_word", "last_word", "start", "end", "cluster", "goes", "near").repartition(*text).sortWithinPartitions(*text)

    def merged(first: np.ndarray, last: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Where new unions of ranges that touch begin, of ranges sorted by text and first."""
        wide = int(last.max(initial=0)) + 1
        reach = np.maximum.accumulate(text * wide + last)
        return np.append(True, first[1:] + text[1:] * wide > reach[:-1])[: len(first)]

    def trim(first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, near: np.ndarray, text: np.ndarray, new: np.ndarray) -> None:
        """Cuts blocks at either end of a union down to the seeds' spans in them, if any, so that words of the document's own beside a passage stay."""
        size = np.diff(np.append(new, len(first)))
        head, tail = np.repeat(first[new], size), np.repeat(np.maximum.reduceat(last, new), size)
        wide = int(last.max(initial=0)) + 1
        seeds = np.flatnonzero(~near)
        if not len(seeds):
            return
        union = np.flatnonzero(merged(first[seeds], last[seeds], text[seeds]))
        low_at, high_at = np.maximum.reduceat(last[seeds], union), first[seeds][union]
        low_end, high_start = np.maximum.reduceat(end[seeds], union), start[seeds][union]
        of = text[seeds][union] * wide
        low = np.searchsorted(low_at + of, first + text * wide, "right")  # the first union that ends behind the block's beginning
        high = np.searchsorted(high_at + of, last + text * wide, "left") - 1  # the last one that begins before its end
        inside = near & (low <= high)
        left, right = np.flatnonzero(inside & (first == head)), np.flatnonzero(inside & (last == tail))
        at = low[left]
        later = high_at[at] > first[left]
        first[left[later]], start[left[later]] = high_at[at[later]], high_start[at[later]]
        at = high[right]
        sooner = low_at[at] < last[right]
        last[right[sooner]], end[right[sooner]] = low_at[at[sooner]], low_end[at[sooner]]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in _whole(batches):
            first, last, start, end, cluster, goes, near = (batch.column(k).to_numpy() for k in range(2, 9))
            begin = np.append(0, _changes(batch))
            text = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, batch.num_rows)))
            order = np.lexsort((last, first, text))
            first, last, start, end, cluster, goes, near, text = (x[order] for x in (first, last, start, end, cluster, goes, near, text))
            new = np.flatnonzero(merged(first, last, text))
            trim(first, last, start, end, near, text, new)
            new = np.flatnonzero(merged(first, last, text))
            island = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(first))))
            gone = np.flatnonzero(goes)
            new_cut = np.flatnonzero(merged(first[gone], last[gone], text[gone]))
            cut_start = start[gone][new_cut]
            cut_end = np.maximum.reduceat(end[gone], new_cut) if len(gone) else cut_start
            cut_words = (np.maximum.reduceat(last[gone], new_cut) if len(gone) else cut_start) - first[gone][new_cut]
            cut_island = island[gone][new_cut]
            cuts = np.searchsorted(cut_island, np.arange(len(new) + 1)).astype(np.int32)
            removed = np.bincount(cut_island, weights=cut_words, minlength=len(new)).astype(np.int64)
            names = np.unique(np.stack([island, cluster]), axis=1)
            own = np.searchsorted(names[0], np.arange(len(new) + 1)).astype(np.int32)
            of = pa.array(begin[text[new]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).combine_chunks().take(of) for k in (0, 1)), pa.array(start[new]), pa.array(np.maximum.reduceat(end, new)), pa.array(np.maximum.reduceat(last, new) - first[new]), pa.array(removed), pa.array(np.diff(cuts) > 0),
                 pa.ListArray.from_arrays(own, pa.array(names[1])), pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(cut_start), pa.array(cut_end)], fields=list(cut_type)))],
                ["doc_id", "text_key", "start", "end", "n_words", "n_removed_words", "removed", "clusters", "cuts"])

    return found.mapInArrow(joined, PASSAGES)


def repeated_passages(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, min_words: int = MIN_WORDS, blocks: bool = True) -> DataFrame:
    """A row for each passage that repeats across documents.

    doc_id, start, end (characters), n_words, n_removed_words, removed (whether
    any of it goes), clusters (its paragraphs' components) and cuts (the spans
    that go, in order).  percent and recall are for blocks.
    """
    return _passages(docs, percent, recall, min_words, blocks).drop("text_key")


def cuts(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, min_words: int = MIN_WORDS, blocks: bool = True) -> DataFrame:
    """doc_id, text_key and the spans that go (cuts) of each text of which anything goes; see without()."""
    return _passages(docs, percent, recall, min_words, blocks).where("removed").groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the spans that cuts() found, all columns kept; n_chars, if there, is counted anew.

    Documents without any word left go, if they had one before.
    """
    at_id, at_key, at_cuts = fresh(docs, "cut_id", "cut_key", "cut_spans")
    spans = spans.select(F.col("doc_id").alias(at_id), F.col("text_key").alias(at_key), F.col("cuts").alias(at_cuts))
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col(at_id)) & (F.xxhash64("text") == F.col(at_key)), "left").drop(at_id, at_key)
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            for k, spans in enumerate(batch.column(len(names)).to_pylist()):
                if spans:
                    out, last = [], 0
                    for span in sorted((s["start"], s["end"]) for s in spans):
                        out.append(texts[k][last : max(last, span[0])])
                        last = max(last, span[1])
                    texts[k] = "".join(out) + texts[k][last:]
                    keep[k] = bool(texts[k].strip("\t\n\v\f\r "))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    out = joined.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def without_repeats(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, min_words: int = MIN_WORDS, blocks: bool = True) -> DataFrame:
    """docs with the repeated passages cut out; see without()."""
    return without(docs, cuts(docs, percent, recall, min_words, blocks))
