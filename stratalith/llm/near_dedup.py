"""Near duplicates by a MinHash LSH forest, confirmed on full shingle sets.

Documents with equal shingle sets are one class and go on as one row.  Every
class gets ``TREES`` signatures of ``DEPTH`` MinHash values.  For each tree the
classes are range-sorted by signature; neighbours with a long common prefix
stand side by side.  A region is a run with a common prefix.  Where a region
is small all its pairs are candidates; where it is large, it is split by the
next value, so the depth adapts to how crowded the region is.  A region that
is large at full depth is compared exactly: first every member with the
region's ``PIVOTS`` most central rows, then, what these links have not joined,
by full sets in blocks of bounded size.  A pair at similarity j is thus
compared, or its members are in one component anyway, with a probability of
1 - (1 - j**DEPTH)**TREES at least, however crowded it stands (0.9995 at 0.85).

Tasks go through their sorted rows in chunks and hold no region as a whole.  A
row carries a byte of each of its first ``MARKS`` MinHash values; pairs whose
bytes say that they are far from similar (by more than four standard errors)
are dropped before they are written.  The rest are confirmed by intersecting
full sets, and links are closed to components.

Edge cases: a null or blank text has an empty set, is linked with nothing and
kept.  Fewer words than a shingle has make one shingle.  Rows that repeat a
doc_id are one node.  Rows with a null doc_id are members of classes but never
their smallest id; their component is null if no row of it has an id.  A very
long text is a block of its own; its set is compared as a whole.  Ties: a
component is named by its smallest id.  An empty table gives an empty result.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .common import IdFilter, components, prepare, table

WORDS, PERCENT = 5, 85
TREES, DEPTH = 24, 8
SMALL, PIVOTS = 16, 2
HASHES = TREES * DEPTH
CHUNK = 1 << 17  # rows that a task looks at together
TASK_ROWS = 1 << 21  # rows of all trees for each task, about
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19  # about what a block of a large region holds
FEW = 16  # members that share a shingle, up to which their pairs are listed
MARKS = 32  # the values of which a row carries a byte
_rng = np.random.Generator(np.random.PCG64(7))
_FACTOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def least_agreement(percent: int, hashes: int = MARKS) -> int:
    """Of so many MinHash values how many must agree at least: four standard errors below the threshold."""
    j = percent / 100
    return int(hashes * (j - 4 * (j * (1 - j) / hashes) ** 0.5))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = textkit.LOWER[data]
    starts, ends, first = textkit.words(low, offsets)
    hashes = textkit.word_hashes(low, starts, ends)
    rolled = textkit.windows(hashes, WORDS)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(rolled[a : b - WORDS + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            out.append(np.array([textkit.whole(hashes[a:b])] if b > a else [], np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values of 16 bits for each set; empty sets get zeros."""
    out = np.zeros((len(sets), HASHES), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    values = np.concatenate([sets[k] for k in full])
    at = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
    for h in range(HASHES):
        out[full, h] = (np.minimum.reduceat(values * _FACTOR[h] + _ADD[h], at) >> np.uint64(48)).astype(np.uint16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * (rows.shape[1] * rows.itemsize)).astype(np.int32)), pa.py_buffer(rows)])


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, size, set_a and set_b (128 bits that name the set), signature (big-endian bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textkit.blocks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                sums = np.array([(s.sum(dtype=np.uint64), textkit.mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), _binary(signatures(sets).astype(">u2"))],
                    ["doc_id", "size", "set_a", "set_b", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, size long, set_a long, set_b long, signature binary")


class Regions:
    """Goes through rows sorted by tree and key, chunk by chunk.

    Rows are arrays by name: tree, keys (DEPTH values each), marks (MARKS bytes
    each), sizes (of their sets) and rep.  The last SMALL + 1 rows of a chunk
    are seen again with the next one, so a small region is seen as a whole; of
    a region that is large at full depth only the pivots are kept.
    """

    NAMES = ("tree", "keys", "marks", "sizes", "rep")

    def __init__(self, percent: int):
        self.percent, self.least = percent, least_agreement(percent)
        self.rest: dict[str, np.ndarray] | None = None
        self.told = np.zeros(0, bool)  # which of the rest are reported as members of a large region
        self.crowd: tuple | None = None  # tree, key, lead and pivots of the large region at the end of the last chunk
        self.found: list[np.ndarray] = []

    def pair(self, x: dict[str, np.ndarray], a: np.ndarray, y: dict[str, np.ndarray], b: np.ndarray) -> None:
        for k in range(0, len(a), 1 << 16):
            i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            m, n = x["sizes"][i], y["sizes"][j]
            near = 100 * np.minimum(m, n) >= self.percent * np.maximum(m, n)
            i, j = i[near], j[near]
            near = (x["marks"][i] == y["marks"][j]).sum(1) >= self.least
            p, q = x["rep"][i[near]], y["rep"][j[near]]
            self.found.append(np.stack([np.maximum(p, q), np.minimum(p, q)]))

    def chunk(self, rows: dict[str, np.ndarray], last: bool) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Candidate pairs (two rows of ids), and of the members of large regions: rep, lead, tree and size."""
        told = np.concatenate([self.told, np.zeros(len(rows["rep"]), bool)])
        if self.rest is not None:
            rows = {k: np.concatenate([self.rest[k], rows[k]]) for k in self.NAMES}
        n, self.found, members = len(rows["rep"]), [], []
        common = np.cumprod(rows["keys"][1:] == rows["keys"][:-1], axis=1).sum(1) if n else np.zeros(0, np.int64)
        common[rows["tree"][1:] != rows["tree"][:-1]] = 0
        waiting, crowd = np.ones(n, bool), None  # waiting: rows whose region is still too large, or not at its end
        for depth in range(1, DEPTH + 1) if n else ():
            cut = np.flatnonzero(np.append(True, common < depth))
            size = np.diff(np.append(cut, n))
            region = np.repeat(np.arange(len(cut)), size)
            small = size <= SMALL
            small[-1] &= last
            go = waiting & small[region]
            for step in range(1, SMALL):
                a = np.flatnonzero(go[: n - step] & (region[: n - step] == region[step:]))
                if not len(a):
                    break
                self.pair(rows, a, rows, a + step)
            waiting &= ~small[region]
            for k in np.flatnonzero(size > SMALL).tolist() if depth == DEPTH else ():
                own = np.arange(cut[k], cut[k] + size[k])
                name = (int(rows["tree"][own[0]]), rows["keys"][own[0]].tobytes())
                if k == 0 and self.crowd is not None and self.crowd[0] == name:
                    _, lead, pivots = self.crowd
                else:
                    usual = np.array([np.bincount(rows["marks"][own, h], minlength=1).argmax() for h in range(MARKS)], np.uint8)
                    top = own[np.argsort(-(rows["marks"][own] == usual).sum(1), kind="stable")[:PIVOTS]]
                    lead, pivots = int(rows["rep"][own[0]]), {c: rows[c][top] for c in self.NAMES}
                own = own[~told[own]]
                for p in range(PIVOTS):
                    self.pair(rows, own, pivots, np.full(len(own), p))
                members.append((rows["rep"][own], np.full(len(own), lead), rows["tree"][own], rows["sizes"][own]))
                told[own] = True
                crowd = (name, lead, pivots)
        at = max(0, n - SMALL - 1)
        self.rest, self.told = {k: rows[k][at:] for k in self.NAMES}, told[at:]
        at_end = crowd is not None and crowd[0] == (int(rows["tree"][-1]), rows["keys"][-1].tobytes())
        self.crowd = crowd if at_end else None
        pairs = np.unique(np.concatenate(self.found, axis=1), axis=1) if self.found else np.zeros((2, 0), np.int64)
        groups = tuple(np.concatenate(x) for x in zip(*members, strict=True)) if members else (np.zeros(0, np.int64),) * 4
        return pairs[:, pairs[0] != pairs[1]], groups


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """What the trees say of the classes (rep, size, signature).

    Rows without a tree: pairs a > b of class ids, perhaps repeated.  Rows with a tree: class a, of this size, is in
    the large region of this tree that is named by b, the least id seen of it.
    """
    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            values = np.frombuffer(textkit.flat(batch.column("signature"))[0], ">u2").reshape(n, HASHES)
            marks = _binary(values[:, :MARKS].astype(np.uint8))
            for t in range(TREES):
                key = _binary(values[:, DEPTH * t : DEPTH * (t + 1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), key, batch.column("rep"), batch.column("size"), marks], ["tree", "key", "rep", "size", "marks"])

    rows = classes.mapInArrow(planted, "tree int, key binary, rep long, size long, marks binary")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * TREES // TASK_ROWS))
    rows = rows.repartitionByRange(parts, "tree", "key").sortWithinPartitions("tree", "key", "rep")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions, held = Regions(percent), []

        def looked(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            pair, (rep, lead, tree, size) = regions.chunk({
                "tree": rows.column("tree").to_numpy(), "keys": np.frombuffer(textkit.flat(rows.column("key"))[0], ">u2").reshape(-1, DEPTH), "marks": textkit.flat(rows.column("marks"))[0].reshape(-1, MARKS),
                "sizes": rows.column("size").to_numpy(), "rep": rows.column("rep").to_numpy()}, last)
            none = pa.nulls(pair.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), none.cast(pa.int32()), none], ["a", "b", "tree", "size"])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(lead), pa.array(tree.astype(np.int32)), pa.array(size)], ["a", "b", "tree", "size"])

        for batch in batches:
            if sum(b.num_rows for b in held) >= CHUNK:
                yield from looked(False)
            held.append(batch)
        if held:
            yield from looked(True)

    return rows.mapInArrow(pairs, "a long, b long, tree int, size long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and shingles of the documents in ids (distinct, column id) and of few others."""
    wanted = IdFilter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column(0).fill_null(0).to_numpy())))
            for first, last, data, offsets in textkit.blocks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(at, pa.array(values))], ["doc_id", "shingles"])

    return table(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>"), "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (doc_id, shingles) are similar; neither side has a bound, so neither is broadcast."""
    right = pairs.hint("merge").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = right.hint("merge").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    same = F.size(F.array_intersect("x", "y"))
    return both.where(same * 100 >= percent * (F.size("x") + F.size("y") - same)).select("a", "b")


def similar_pairs(values: np.ndarray, sizes: np.ndarray, root: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets of different roots that are similar; values: the sets' members, one set behind the other."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    order = np.lexsort((row, column))
    row, column, count = row[order], column[order], count[column[order]]
    shared = np.zeros((n, n), np.float32)
    few = (count > 1) & (count <= FEW)
    r, c = row[few], column[few]
    for step in range(1, FEW):
        k = np.flatnonzero(c[step:] == c[:-step])
        np.add.at(shared, (r[k], r[k + step]), 1)
    many = count > FEW
    r, c = row[many], column[many]
    c = np.cumsum(np.append(False, c[1:] != c[:-1])[: len(c)])
    for first in range(0, int(c[-1]) + 1 if len(c) else 0, 2048):
        a, b = np.searchsorted(c, [first, first + 2048])
        has = np.zeros((n, 2048), np.float32)
        has[r[a:b], c[a:b] - first] = 1
        shared += has @ has.T
    near = 100 * shared.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - shared.astype(np.int64))
    return np.nonzero(np.triu(near & (root[:, None] != root[None, :]), 1))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as stars: each node that is not the least of its component, and the least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while (apart := least[i] != least[j]).any():
        i, j = i[apart], j[apart]
        np.minimum.at(least, np.maximum(least[i], least[j]), np.minimum(least[i], least[j]))
        while (least[least] != least).any():
            least = least[least]
    more = least != np.arange(len(nodes))
    return nodes[more], nodes[least[more]]


def crowd_links(members: DataFrame, roots: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Different roots (root_a, root_b) that are linked within the large regions, a star for each component of two blocks, so that they are no more than the roots there.

    members: rep, size, tree and lead, the last two naming the region; roots: node and root of what is linked already;
    sets_of: gives doc_id and shingles of the ids (column id) at least.
    A region's most frequent root is not compared with itself, so its members meet only the blocks of the rest.
    """
    region = ["tree", "lead"]
    members = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    by_root = members.groupBy(*region, "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    open_ = by_root.groupBy(*region).agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("all")).where("n > top.n")

    def parts(n, size):
        return F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    open_ = open_.select(*region, F.col("top.root").alias("top"), parts(F.col("top.n"), F.col("top.size")).alias("p"), parts(F.col("n") - F.col("top.n"), F.col("all") - F.col("top.size")).alias("q"))
    rows = table(members.select(*region, "rep", "root").join(open_, region), "crowds")
    sets = sets_of(rows.select(F.col("rep").alias("id")).distinct())
    hashed, q = F.xxhash64("rep", "tree"), F.col("q")
    rest = F.pmod(hashed, q).cast("int")
    top = (q + F.pmod(hashed, F.col("p"))).cast("int")

    def to(first, behind, pair):
        return F.transform(F.sequence(first, behind - 1), pair)

    with_rest = to(F.lit(0), q, lambda j: F.struct(F.least(rest, j).alias("x"), F.greatest(rest, j).alias("y")))
    with_top = to(q, q + F.col("p"), lambda j: F.struct(rest.alias("x"), j.alias("y")))
    of_top = to(F.lit(0), q, lambda j: F.struct(j.alias("x"), top.alias("y")))
    pair = F.when(F.col("root") == F.col("top"), of_top).otherwise(F.concat(with_rest, with_top))
    rows = rows.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select(*region, "root", "shingles", F.explode(pair).alias("k")).select(*region, "k.x", "k.y", "root", "shingles")

    def linked(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("shingles").combine_chunks()
        root = group.column("root").to_numpy()
        i, j = similar_pairs(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), root, percent)
        return pa.table(spanning(root[i], root[j]), ["root_a", "root_b"])

    return rows.groupBy(*region, "x", "y").applyInArrow(linked, "root_a long, root_b long").distinct()


def closed(pairs: DataFrame, members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """node and root of all that is linked: by similar pairs (a, b), and between the members of large regions (see crowd_links)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    roots = table(components(confirmed(pairs, sets_of(ids), percent)), "roots")
    if not members.head(1):
        return roots
    more = table(crowd_links(members, roots, sets_of, percent), "more")
    whole = components(more, "root_a", "root_b").select(F.col("node").alias("part"), F.col("root").alias("whole"))
    parts = roots.union(whole.select("part", F.col("part").alias("root"))).distinct()
    return table(parts.join(whole, F.col("root") == F.col("part"), "left").select("node", F.coalesce("whole", "root").alias("root")), "roots")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = table(_signed(rows), "signatures")
    classes = signed.where("size > 0").groupBy("size", "set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    classes = table(classes, "classes")
    met = table(candidates(classes.where("rep is not null").select("rep", "size", "signature"), percent), "met")
    pairs = table(met.where("tree is null").select("a", "b").distinct(), "pairs")
    members = met.where("tree is not null").select(F.col("a").alias("rep"), F.col("b").alias("lead"), "tree", "size")
    roots = closed(pairs, members, lambda ids: _sets(rows, ids), percent)
    named = classes.select("size", "set_a", "set_b", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("size", "set_a", "set_b", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "size", "set_a", "set_b").join(named, ["size", "set_a", "set_b"], "left")
    component = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), (component.isNull() | component.eqNullSafe(F.col("doc_id"))).alias("kept"))


#: All pairs, exactly; the forest finds the same links on tables of this size.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY k),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN c ca ON ca.rep = a.doc_id JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN c cb ON cb.rep = b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b WHERE 100 * shared >= 85 * (ca.n + cb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
m AS (SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN m ON m.x = c.rep
"""
