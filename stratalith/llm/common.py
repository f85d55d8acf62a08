"""What the operators of this subpackage share: scratch tables and shipping.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, which all
executors see, so a lost executor never loses an intermediate result.  A table
belongs to the result that reads it: ``settled`` writes a result and deletes
what it was made from; whatever else is left goes when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

#: The white space that separates words: tab to carriage return, and blank.
SPACE = r"[\x20\x09-\x0D]"

_shipped: dict[str, bool] = {}
_tables: list[str] = []
_inner: ContextVar[list[str] | None] = ContextVar("_inner", default=None)  # the tables of the innermost settled()
_own: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        folder = Path(tempfile.mkdtemp(prefix="stratalith-ship-"))  # local mode reads the file again for each task set
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(package, folder / "staged" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(folder / f"{package.name}_src"), "zip", folder / "staged"))
        _shipped[app] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and (master.startswith("local-cluster") or not master.startswith("local")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="stratalith-"))
    return (folder or _own[0]).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, for as long as the result that is being made needs it."""
    if not _tables:
        atexit.unregister(_clear)
        atexit.register(_clear)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = _inner.get()
    (_tables if own is None else own).append(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and Spark knows its size."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make() as a table of their own; the tables that make() wrote are deleted, and no others."""
    own: list[str] = []
    outer = _inner.set(own)
    try:
        rows = make()
        _inner.reset(outer)
        outer = None
        return table(rows, name)
    finally:
        if outer is not None:
            _inner.reset(outer)
        for path in own:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that results made so far read; for when none of them is still to run."""
    while _tables:
        delete(spark, _tables.pop())


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)
    for folder in _own:
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of their letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class IdFilter:
    """A Bloom filter of longs with a fixed size, so that it can go to every task whatever the input.

    With 2**26 bits (8 MB) and four bits for each id one in a hundred others
    passes at 7 million ids.  Beyond that more pass, which costs time but no
    result: whoever uses it joins exactly afterwards.
    """

    PROBES = 4

    def __init__(self, ids: DataFrame, bits: int = 1 << 26):
        """ids: one column of longs, nulls aside.  Spark sets the bits; bits / 64 words come to the driver at most."""
        self.bits = bits

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(places(batch.column(0).drop_null().to_numpy(), bits))
                word, first = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.int64(1) << (at & 63), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value)], ["at", "word"])

        words = ids.mapInArrow(set_bits, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        self.words = np.zeros(bits // 64, np.int64)
        self.words[words.column("at").to_numpy()] = words.column("word").to_numpy()

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id may be in the filter."""
        at = places(ids, self.bits)
        return ((self.words[at >> 6] >> (at & 63)) & 1).astype(bool).all(1)


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits that stand for each id."""
    x = np.asarray(ids, np.int64).view(np.uint64)
    steps = np.arange(1, IdFilter.PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (textkit.mix(x[:, None] ^ steps) % np.uint64(bits)).astype(np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: pairs of longs; loops, repeats and nulls do no harm.  Returns
    (node, root), root being the smallest id of its component, for each node
    that has an edge to another.  Each round is two joins on written tables;
    only two numbers of a round come to the driver.
    """
    def clean(df: DataFrame) -> DataFrame:
        return df.where("a is not null and b is not null and a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = table(clean(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))), "edges")
    before = mark(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # apart, so that Spark can split a hub's join
        large = clean(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = table(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        now = table(clean(small), "small")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
