"""Near duplicates by SimHash, found around the anchors of a covering code.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the
XXH64 values of the text's shingles.  Two fingerprints are linked if they
differ in two bits at most, and links are closed to components.

Anchors are the words of the product of two perfect Golay codes on the first
46 bits; the last 18 bits are left free.  In either half every word lies within
three bits of exactly one code word.  A fingerprint is at home at the anchor
next to it and visits all anchors that are farther off by two bits more at
most (61 on average, its home included).  If two fingerprints differ in two
bits, each visits the other's home; so every link is found by comparing the
fingerprints at home at an anchor with its visitors.

There are 2**24 anchors.  A map of those that are somebody's home has 2 MB,
whatever the input, goes to all tasks, and spares visits that would meet
nobody.  An anchor that is home to more than ``CROWD`` fingerprints is left out
of that; its fingerprints go to all 64-bit words within one bit (65 rows each)
and meet there.  Two that differ in two bits share such a word, a word has 65
guests at most, and all of them are linked; so crowds cost linear work too.

Equal fingerprints are one row before any of that, so copies cost nothing.

Edge cases: a null or blank text has fingerprint zero and is linked like any
other; fewer words than a shingle make one shingle.  Texts are read in pieces,
so a very long one is no burden.  Rows that repeat a doc_id are rows of their
own; rows with a null doc_id belong to a component but never name it, and its
name is null if no row of it has an id.  Ties: a component is named by its
smallest id.  An empty table gives an empty result.  Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import components, prepare, table

WORDS, SEED, DISTANCE = 3, 42, 2
#: Fingerprints at home at an anchor up to which its visitors are compared with all of them.
CROWD = 128
PIECE = 1 << 20
#: The Golay code's length, its check bits and its generator polynomial (fixed values).
LENGTH, CHECKS, GENERATOR = 23, 11, 0b101011100011
RADIUS = 3
INFO = LENGTH - CHECKS
FREE = 64 - 2 * LENGTH
SLICE = 1 << 13
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = b" \t\n\x0b\x0c\r"


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces that end at white space, of PIECE bytes or one word more."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def fingerprint(text: bytes) -> int:
    """The 64 bits of a text, lower-cased and cut into words here."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    for piece in pieces(text):
        words = carried + piece.translate(_LOWER).split()
        n = len(words) - WORDS + 1
        carried = words[max(0, n) :]
        if n > 0:
            joined, sizes = b" ".join(words), np.array(list(map(len, words)), np.int64)
            ends = np.cumsum(sizes + 1) - 1
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip((ends - sizes)[:n].tolist(), ends[WORDS - 1 :].tolist())]
            ones += _ones(hashes)
            total += n
    if not total and carried:
        ones, total = _ones([xxhash.xxh64_intdigest(b" ".join(carried), SEED)]), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, from the highest."""
    out = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[k : k + (1 << 16)], ">u8").view(np.uint8)).reshape(-1, 64)
        out += bits.sum(0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a long with the fingerprint's bits) of each row."""
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.flat(batch.column(1))
            values = [fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compute, "doc_id long, fp long")


def _syndrome(word: int) -> int:
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECKS)
    return word


@cache
def cosets() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Syndromes of all 23-bit words, and for 0, 1 and 2 bits beyond the radius (starts by syndrome, differences that lead to code words)."""
    single = np.array([_syndrome(1 << k) for k in range(LENGTH)], np.int16)
    syndromes = np.zeros(1, np.int16)
    for k in range(LENGTH):
        syndromes = np.concatenate([syndromes, syndromes ^ single[k]])
    classes = []
    for weights in (range(RADIUS + 1), *([RADIUS + k] for k in range(1, DISTANCE + 1))):
        words = np.array([sum(1 << k for k in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.int64)
        words = words[np.argsort(syndromes[words], kind="stable")]
        classes.append((np.searchsorted(syndromes[words], np.arange((1 << CHECKS) + 1)), words))
    return syndromes, classes


def anchors(fps: np.ndarray, beyond: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, anchor) for all anchors up to so many bits beyond the covering radius."""
    syndromes, classes = cosets()
    x = fps.view(np.uint64)
    mask = np.uint64((1 << LENGTH) - 1)
    halves = [((x >> np.uint64(FREE + LENGTH)) & mask).astype(np.int64), ((x >> np.uint64(FREE)) & mask).astype(np.int64)]
    of, at = [], []
    for first in range(beyond + 1):
        for second in range(beyond + 1 - first):
            picks = []
            for half, (starts, words) in zip(halves, (classes[first], classes[second])):
                s = syndromes[half]
                picks.append((half, starts[s], starts[s + 1] - starts[s], words))
            (h1, s1, n1, w1), (h2, s2, n2, w2) = picks
            n = n1 * n2
            row = np.repeat(np.arange(len(x)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            a = (h1[row] ^ w1[s1[row] + k // n2[row]]) >> CHECKS
            b = (h2[row] ^ w2[s2[row] + k % n2[row]]) >> CHECKS
            of.append(row)
            at.append((a << INFO | b).astype(np.int32))
    return np.concatenate(of), np.concatenate(at)


def _placed(fps: DataFrame, beyond: int, taken: np.ndarray | None = None) -> DataFrame:
    """anchor and fp of the homes (beyond 0) or of all visits; taken: a bit for each anchor that counts."""
    bits = fps.sparkSession.sparkContext.broadcast(taken) if taken is not None else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(values), SLICE):
                part = values[k : k + SLICE]
                of, at = anchors(part, beyond)
                if bits is not None:
                    keep = (bits.value[at >> 6] >> (at & 63) & 1).astype(bool)
                    of, at = of[keep], at[keep]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[of])], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(place, "anchor int, fp long")


def _taken(homes: DataFrame) -> np.ndarray:
    """The map of anchors that are homes: 2**18 words at most come to the driver."""
    words = homes.groupBy(F.shiftright("anchor", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, anchor % 64))").alias("word")).toArrow()
    out = np.zeros(1 << (2 * INFO - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs a, b of different fingerprints (column fp, no repeats) that differ in two bits at most.

    Of a crowd each fingerprint is paired with the least guest of every word that it meets others at, which joins the same fingerprints.
    """
    homes = table(_placed(fps, 0), "homes")
    crowded = table(homes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "crowded")
    calm = homes.join(crowded, "anchor", "left_anti")
    visits = _placed(fps, DISTANCE, _taken(calm)).withColumnRenamed("fp", "b")
    near = calm.withColumnRenamed("fp", "a").join(visits, "anchor").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(values), SLICE):
                part = values[k : k + SLICE]
                words = (part.view(np.uint64)[:, None] ^ steps).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(part, len(steps)))], ["word", "fp"])

    guests = homes.join(crowded, "anchor", "left_semi").select("fp").mapInArrow(around, "word long, fp long")
    met = guests.groupBy("word").agg(F.collect_list("fp").alias("guests")).where("size(guests) > 1")  # 65 at most
    met = met.select(F.array_min("guests").alias("a"), F.explode("guests").alias("b")).where("a <> b").distinct()
    return near.union(met)


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    prepare(docs.sparkSession)
    rows = table(fingerprints(docs), "fingerprints")
    classes = table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(table(links(classes.select("fp"), crowd), "links"))
    named = table(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = table(named.join(ids, "root").select("fp", "component_id"), "named")  # apart, so that Spark can split the join of a hot fingerprint
    return rows.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
