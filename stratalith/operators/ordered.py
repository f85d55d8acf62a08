"""Operators over ordered rows: carry forward, islands, spans, parents, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, keys: list[str], order: list[str], hit: Column, value: Column, name: str, within: int | None = None) -> DataFrame:
    """Adds the value of the last row before or at each row where ``hit`` holds; within: how many rows to look back."""
    w = Window.partitionBy(*keys).orderBy(*order)
    w = w.rowsBetween(-within, 0) if within is not None else w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(hit, value), ignorenulls=True).over(w))


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0; a run begins where ``starts`` holds, and with the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_s", F.coalesce(starts, F.lit(False))).withColumn(
        name, F.sum(F.when(F.col("_s") & (F.row_number().over(w) > 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def by_gap(df: DataFrame, keys: list[str], at: str, gap: float, name: str = "island") -> DataFrame:
    """Runs of rows less than ``gap`` apart."""
    w = Window.partitionBy(*keys).orderBy(at)
    return islands(df.withColumn("_before", F.lag(at).over(w)), keys, [at], F.col(at) - F.col("_before") >= gap, name).drop("_before")


def spans(df: DataFrame, keys: list[str], at: str, end: str = "next_at") -> DataFrame:
    """Adds where the next row of the same keys begins; null for the last."""
    return df.withColumn(end, F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def numbered_names(df: DataFrame, keys: list[str], name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """X, X_1, X_2 for rows that share a name, in order."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))


def above(items: Column) -> Column:
    """For each of an array of items (l and n, in order) the name of the nearest one before with a smaller level; an item whose level is null is above none and below none.

    The fold keeps the stack of open levels; the items are one record's layout, some thousand at most.
    """
    kind = "struct<stack:array<struct<l:int,n:string>>,out:array<string>>"
    zero = F.from_json(F.lit('{"stack":[],"out":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        stack = F.filter(acc["stack"], lambda s: s["l"] < x["l"])
        p = F.when(x["l"].isNotNull() & (F.size(stack) > 0), F.element_at(stack, -1)["n"])
        one = F.struct(x["l"].cast("int").alias("l"), x["n"].alias("n"))
        return F.struct(F.when(x["l"].isNull(), acc["stack"]).otherwise(F.concat(stack, F.array(one))).alias("stack"), F.concat(acc["out"], F.array(p)).alias("out")).cast(kind)

    return F.aggregate(items, zero, step, lambda acc: acc["out"])


def parents(items: DataFrame, keys: list[str], order: str, level: str, name: str, skip: Column | None = None) -> DataFrame:
    """Adds parent, the nearest item before with a smaller level (see ``above``); all columns are kept.  Items for which skip holds neither have nor are one.

    The items go through one aggregation of their key and are joined with nothing: sizes of made rows are not known beforehand, and a join might be broadcast.
    """
    open_ = F.col(level) if skip is None else F.when(~skip, F.col(level))
    item = F.struct(F.col(order).alias("_o"), open_.alias("l"), F.col(name).alias("n"), *(F.col(c) for c in items.columns if c not in keys))
    rows = items.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("xs")).select(*keys, "xs", above(F.col("xs")).alias("ps"))
    rows = rows.select(*keys, F.explode(F.arrays_zip(F.col("xs").alias("x"), F.col("ps").alias("p"))).alias("z"))
    return rows.select(*(F.col(c) if c in keys else F.col(f"z.x.{c}").alias(c) for c in items.columns), F.col("z.p").alias("parent"))


def deepest(marks: Column) -> Column:
    """The greatest depth of an array of +1 and -1, never below 0."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, m: Column) -> Column:
        now = F.greatest(F.lit(0), acc["now"] + m)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, zero, step, lambda acc: acc["most"])


def round_robin(df: DataFrame, order: list[str], n: int, keys: list[str] | None = None, name: str = "slot") -> DataFrame:
    """Deals the rows of each key to n slots in turn."""
    if not keys:
        raise ValueError("give keys: dealing all rows in one order would put them into one task")
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) % n)


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits within each task before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
