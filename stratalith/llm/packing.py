"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt to shards by a hash of their id, length and, where rows
repeat both, their number among these, and every shard is packed by itself, so
no task holds more than its shard.  A document longer than the
largest length is cut into pieces of that length and a rest.  Pieces are taken
from long to short and go to the open bin that they leave with the least room
(best fit over the contents of all bins of the shard, whatever their size).
If none has room, the bin is opened whose cost for each token it is expected
to hold is least among the permitted lengths that hold the piece.  A sequence
costs its length, ``overhead`` tokens, and length**2 / ``square`` for
attention; it is expected to be filled but for half the shortest piece, as far
as the shard's pieces still to come suffice.  So long sequences save overhead
and short ones attention.  When all pieces are placed, every bin is downsized to the least permitted
length that holds its contents.

Edge cases: null and negative lengths count as 0, and documents without tokens
get a row with no bin.  Documents longer than the longest bin are cut into
pieces.  Rows that repeat an id are packed each.  Ties: of pieces of one length
the smaller id goes first, of bins with equal room the one opened first.  An empty
table gives an empty result.  Columns other than the id and the length are not
looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, table

LENGTHS = (512, 1024, 2048, 4096, 8192)
COPIES = 1 << 16  # rows that repeat an id and a length, made by one task
SCHEMA = "doc_id long, piece int, start long, n_tokens long, shard int, bin long, position int, bin_offset long, bin_used long, bin_length long"


def cheapest(size: int, rest: int, shortest: int, lengths: Sequence[int], overhead: int, square: int) -> int:
    """The length to open for a piece of this size when the pieces still to come have ``rest`` tokens in all, the shortest of them so many."""
    def cost(length: int) -> float:
        filled = min(length - min(length - size, shortest / 2), size + rest)
        return (length + overhead + length * length / square) / filled

    return min((x for x in lengths if x >= size), key=lambda x: (cost(x), x))


def pack(sizes: np.ndarray, lengths: Sequence[int], overhead: int = 8, square: int = 65_536) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pieces in the order given, from long to short: bin and offset of each; used and final length of each bin."""
    room: list[tuple[int, int]] = []  # of open bins, sorted: (room, bin)
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    rest, shortest = int(sizes.sum()), int(sizes[-1]) if len(sizes) else 0
    for k, size in enumerate(sizes.tolist()):
        rest -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(used), cheapest(size, rest, shortest, lengths, overhead, square)
            used.append(0)
        where[k], offset[k] = b, used[b]
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    final = np.sort(np.asarray(lengths))
    total = np.array(used, np.int64)
    return where, offset, total, final[np.searchsorted(final, total)] if len(total) else total


def best_fit(lengths_of: DataFrame, permitted: Sequence[int] = LENGTHS, overhead: int = 8, square: int = 65_536, shard_rows: int = 20_000, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """A row for each piece of each document, with its place in a bin; see SCHEMA.

    Rows are counted once to choose the number of shards, about one for
    each ``shard_rows`` of them.
    """
    prepare(lengths_of.sparkSession)
    if not permitted or min(permitted) <= 0:
        raise ValueError("permitted needs positive lengths")
    most, sizes = max(permitted), sorted(permitted)
    rows = lengths_of.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    rows = table(rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")), "lengths")  # they are read twice and may cost an encoding
    shards = max(1, -(-(rows.agg(F.sum("copies")).first()[0] or 0) // shard_rows))
    once = rows.where("copies = 1").select("doc_id", "n_tokens", F.lit(0).cast("long").alias("copy"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))  # so that no task makes all copies of a row
    again = rows.where("copies > 1").withColumn("part", part).repartition("doc_id", "n_tokens", "part")
    again = again.select("doc_id", "n_tokens", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1)).alias("copy"))
    rows = once.union(again).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(shards)).cast("int")).drop("copy")

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        n = group.column("n_tokens").to_numpy()
        parts = np.maximum(1, -(-n // most))
        row = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * most
        size = np.minimum(most, n[row] - start)
        order = np.lexsort((np.arange(len(row)), -size))
        order = order[size[order] > 0]
        bin_of, offset, used, final = pack(size[order], sizes, overhead, square)
        none = np.ones(len(row), bool)
        none[order] = False
        values = np.zeros((5, len(row)), np.int64)
        by_bin = np.lexsort((offset, bin_of))
        position = np.zeros(len(order), np.int64)
        starts = np.searchsorted(bin_of[by_bin], np.arange(len(used)))
        position[by_bin] = np.arange(len(order)) - starts[bin_of[by_bin]]
        values[:, order] = bin_of, position, offset, used[bin_of], final[bin_of]
        b, p, o, u, f = (pa.array(v, mask=none) for v in values)
        shard = pa.array(np.full(len(row), group.column("shard")[0].as_py(), np.int32))
        ids = group.column("doc_id").combine_chunks().take(pa.array(row))
        return pa.table([ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), shard, b, p.cast(pa.int32()), o, u, f],
                        ["doc_id", "piece", "start", "n_tokens", "shard", "bin", "position", "bin_offset", "bin_used", "bin_length"])

    return rows.groupBy("shard").applyInArrow(packed, SCHEMA)
