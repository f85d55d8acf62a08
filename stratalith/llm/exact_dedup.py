"""Exact duplicates by counting quotient filters, with byte verification.

Each task turns the 64-bit fingerprints of its texts into counting quotient
filters, one for each block of the fingerprint space.  Filters of a block meet
in one task and are merged without loss: both lists of (quotient, remainder,
count) are sorted, so equal entries stand side by side and their counts add
up.  Fingerprints with a count above one are candidates only; their texts are
grouped by all their bytes, so a fingerprint shared by chance costs a little
work and changes no result.

A hot text, however frequent, is one entry of a filter and, after the partial
aggregation of the byte check, one row of each task.

Edge cases: a null text is an empty text; all empty texts are equal to each
other.  Of equal texts the longest stays, whitespace counted, of equally long
ones the one with the smallest doc_id; a null doc_id counts as the greatest.
Rows that repeat a doc_id count as rows of their own, and if they tie, one of
them stays.  A text of any length is hashed and compared as a whole.  An empty
table gives an empty result.  Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, prepare, table

#: Fingerprints that a task gathers before it emits their filters.
CHUNK = 1 << 20
#: Rows equal in id, length and text that one task writes out.
COPIES = 1 << 16


class CountingQuotientFilter:
    """Fingerprints of ``width`` bits with counts, as quotients and remainders.

    A fingerprint's high ``q`` bits are its quotient, the rest its remainder.
    ``occupied`` has a bit for each quotient, ``runends`` a bit for each slot
    that ends a quotient's run, ``remainders`` the slots in sorted order, and
    ``counters`` the counts of the slots marked in ``counted``; the others
    count one.  The k-th run belongs to the k-th set bit of ``occupied``.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, width: int):
        """fingerprints: sorted, without repeats."""
        n = len(fingerprints)
        self.width, self.slots = width, n
        self.q = min(width, max(1, int(n).bit_length()))
        r = np.uint64(width - self.q)
        quotients = (fingerprints >> r).astype(np.int64)
        self.remainders = fingerprints & ((np.uint64(1) << r) - np.uint64(1))
        occupied = np.zeros(1 << self.q, bool)
        occupied[quotients] = True
        self.occupied = np.packbits(occupied)
        self.runends = np.packbits(np.append(quotients[1:] != quotients[:-1], True)[:n])
        self.counted = np.packbits(counts > 1)
        self.counters = counts[counts > 1].astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints and their counts."""
        n = self.slots
        ends = np.unpackbits(self.runends, count=n).astype(bool)
        run = np.cumsum(ends) - ends
        quotients = np.flatnonzero(np.unpackbits(self.occupied))[run].astype(np.uint64)
        counts = np.ones(n, np.int64)
        counts[np.unpackbits(self.counted, count=n).astype(bool)] = self.counters
        return (quotients << np.uint64(self.width - self.q)) | self.remainders, counts

    def to_bytes(self) -> bytes:
        head = np.array([self.width, self.q, self.slots, len(self.counters)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.remainders, self.counters, self.occupied, self.runends, self.counted))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        out = cls.__new__(cls)
        out.width, out.q, out.slots, n = np.frombuffer(data, np.int64, 4).tolist()
        at = 32
        for name, kind, size in (("remainders", np.uint64, out.slots), ("counters", np.int64, n), ("occupied", np.uint8, -(-(1 << out.q) // 8)), ("runends", np.uint8, -(-out.slots // 8)), ("counted", np.uint8, -(-out.slots // 8))):
            setattr(out, name, np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return out

    @classmethod
    def of(cls, fingerprints: np.ndarray, width: int) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True), width)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """A filter with the sums of all counts."""
        parts = [f.entries() for f in filters]
        keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return cls(keys[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].width)


def repeated(fingerprints: DataFrame, bits: int = 8) -> DataFrame:
    """The fingerprints (column fp, long) that occur more than once; 2**bits blocks are merged apart."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def filters() -> pa.RecordBatch:
            x = np.concatenate(held).view(np.uint64)
            held.clear()
            block = (x >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            x, block = x[order], block[order]
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            low = (np.uint64(1) << np.uint64(64 - bits)) - np.uint64(1)
            data = [CountingQuotientFilter.of(part & low, 64 - bits).to_bytes() for part in np.split(x, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array(data, pa.binary())], ["block", "filter"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= CHUNK:
                yield filters()
        if held:
            yield filters()

    def merged(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        keys, counts = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in group.column("filter").to_pylist()]).entries()
        keys = keys[counts > 1] | (np.uint64(block) << np.uint64(64 - bits))
        return pa.table({"fp": pa.array(keys.view(np.int64))})

    return fingerprints.select("fp").mapInArrow(build, "block int, filter binary").groupBy("block").applyInArrow(merged, "fp long")


def normalised(text: Column) -> Column:
    """What texts are compared by: all but white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    bits: there are 2**bits blocks of fingerprints; None: so many that a block has about CHUNK of them, 256 at least.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.length("text").alias("size"), normalised(F.col("text")).alias("bytes"))
    bits = bits or max(8, (rows.count() // CHUNK).bit_length())
    candidates = table(repeated(rows.select(F.xxhash64("bytes").alias("fp")), bits), "fingerprints")
    same = (
        rows.withColumn("fp", F.xxhash64("bytes")).join(candidates, "fp", "left_semi")
        .groupBy("fp", "bytes").agg(F.count("*").alias("n"), F.max(F.struct("size", F.bitwise_not("doc_id").alias("high"))).alias("best"))
        .where("n > 1").select(F.sha2("bytes", 256).alias("text_sha256"), "best", "n")
    )
    groups = same.groupBy("text_sha256").agg(F.max("best").alias("best"), F.max("n").alias("n"), F.count("*").alias("texts")).select(
        "text_sha256", "best.size", F.bitwise_not("best.high").alias("keep"), F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts have one SHA-256"))).alias("n"))
    groups = table(groups.withColumnRenamed("size", "most"), "groups")  # apart, so that Spark can split the join of a hot text
    # Rows that are equal in id, length and text are one row with their number until the end, so that one of them can stay.
    out = rows.select("doc_id", "size", F.sha2("bytes", 256).alias("text_sha256")).groupBy("doc_id", "size", "text_sha256").agg(F.count("*").alias("copies"))
    alone = F.col("n").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("size") == F.col("most")))
    out = out.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("stays"), "text_sha256", "copies")
    one = out.where("copies = 1").withColumn("copy", F.lit(0).cast("long"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))  # so that no task makes all copies of a row
    many = out.where("copies > 1").withColumn("part", part).repartition("doc_id", "text_sha256", "part")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1))).drop("part")
    return one.union(many).select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 0)).alias("kept"), "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY body) AS group_size FROM t WINDOW w AS (PARTITION BY body ORDER BY size DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""
