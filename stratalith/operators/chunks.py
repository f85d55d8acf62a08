"""Cutting texts into lines and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_ratios(df: DataFrame, key: str, text: str, comment: Callable[[Column], Column]) -> DataFrame:
    """Lines of each text and the shares of empty, comment and other lines; no shuffle."""
    lines = df.select(key, F.split(text, "\n").alias("s"))
    n = F.size("s")
    empty, noted = F.size(F.filter("s", lambda x: F.trim(x) == "")), F.size(F.filter("s", comment))
    return lines.select(key, n.alias("n_lines"), F.round(empty / n, 4).alias("empty_ratio"), F.round(noted / n, 4).alias("comment_ratio"), F.round((n - empty - noted) / n, 4).alias("code_ratio"))


def line_kinds(df: DataFrame, key: str, text: str, kinds: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """How many lines of each text are of each kind; a line is of the first kind that it shows."""
    def kind(x: Column) -> Column:
        out = None
        for name, test in kinds:
            out = F.when(test(x), name) if out is None else out.when(test(x), name)
        return out

    marked = df.select(key, F.transform(F.split(text, "\n"), kind).alias("k"))
    def count(name: str) -> Column:
        return F.size(F.filter("k", lambda k: k == F.lit(name))).cast("long").alias(name)

    return marked.select(key, *[count(name) for name, _ in kinds])


def word_windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """Chunks of ``size`` words, each sharing ``overlap`` words with the one before; a text of up to ``size`` words is one chunk."""
    step = size - overlap
    words = df.select(key, F.array_remove(F.split(text, "[ \n]+"), "").alias("w"))
    last = F.when(F.size("w") <= size, 0).otherwise(F.ceil((F.size("w") - size) / F.lit(float(step)))).cast("int")
    return words.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(key, "chunk", F.slice("w", F.col("chunk") * step + 1, F.lit(size)).alias("words"))


PART = "array<struct<at:int,n:long,size:long,kind:string,x:string>>"


def packed(parts: DataFrame, key: str, budget: int) -> DataFrame:
    """Parts of texts (at, n lines, size, kind, x) packed in order into chunks of at most ``budget``; a larger part is a chunk of its own."""
    part = F.struct(F.col("at").cast("int").alias("at"), F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"), F.col("kind").cast("string").alias("kind"), "x")
    return _pack(parts.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("p")), key, budget)


def packed_lines(df: DataFrame, key: str, text: str, budget: int, cost: Callable[[Column], Column] | None = None) -> DataFrame:
    """Whole lines packed in order into chunks of at most ``budget`` (characters, or what cost gives); a longer line is a chunk of its own.  No shuffle."""
    cost = cost or F.length
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.cast("int").alias("at"), F.lit(1).cast("long").alias("n"), cost(x).cast("long").alias("size"), F.lit(None).cast("string").alias("kind"), x.alias("x")))
    return _pack(df.select(key, F.coalesce(lines, F.array().cast(PART)).alias("p")), key, budget).drop("starts_with")


def _pack(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """The greedy walk over each text's parts, in Arrow batches; its cost grows with the number of parts."""
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "chunk", "first_line", "n_lines", "starts_with", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, count = batch.column(1).flatten(), batch.column(1).value_lengths().to_pylist()
            at, n, size, kinds, x = (p.field(k).to_pylist() for k in range(5))
            owner, out, k = [], [], 0
            for row, parts in enumerate(count):
                chunk, used = -1, 0
                for i in range(k, k + parts):
                    if chunk < 0 or used + size[i] > budget:
                        chunk, used = chunk + 1, 0
                        owner.append(row)
                        out.append((chunk, at[i], [], [], kinds[i]))
                    used += size[i]
                    out[-1][2].append(n[i])
                    out[-1][3].append(x[i])
                k += parts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([sum(o[2]) for o in out], pa.int64()),
                 pa.array([o[4] for o in out], pa.string()), pa.array(["\n".join(o[3]) for o in out], pa.string())], names)

    return rows.mapInArrow(run, f"{key} {kind}, chunk int, first_line int, n_lines long, starts_with string, text string")
