"""Reconciliation of two record sets and data quality rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keep import kept

NULL = "__NULL__"


def text_of(column: str, kind: T.DataType) -> Column:
    """A value as text that is alike on both sides whatever the storage: fractions with six digits."""
    c = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("decimal(28,6)")
    return F.coalesce(c.cast("string"), F.lit(NULL))


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """MD5 of all values of a row, nulls marked."""
    return F.md5(F.concat_ws("|", *[text_of(c, df.schema[c].dataType) for c in columns]))


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    columns = [c for c in left.columns if c in right.columns]
    if not columns:
        raise ValueError("the two sides have no column in common")
    return columns


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each row key how often it occurs on either side; both sides are counted before they meet."""
    columns = common_columns(left, right)
    sides = [df.select(row_key(df, columns).alias("k")).groupBy("k").agg(F.count("*").alias(n)) for df, n in ((left, "n_left"), (right, "n_right"))]
    return sides[0].join(sides[1], "k", "full").select("k", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of either side, matches as multisets, the rest and the match in per cent."""
    sums = matched(left, right).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.col("n_left"), "left_rows"), (F.col("n_right"), "right_rows"), (F.least("n_left", "n_right"), "matching"))])
    most = F.greatest("left_rows", "right_rows")
    return sums.select("*", (F.col("left_rows") - F.col("matching")).alias("left_only"), (F.col("right_rows") - F.col("matching")).alias("right_only"),
                       F.when(most > 0, F.round(F.col("matching") * 100.0 / most, 4)).otherwise(0.0).alias("match_pct"))


def only_in(left: DataFrame, right: DataFrame, order: list[str], k: int | None = 3) -> DataFrame:
    """Rows of left beyond those that right has as well, as multisets; k: how many to show, in order."""
    columns = common_columns(left, right)
    out = left.select(*columns).exceptAll(right.select(*columns))
    return out.orderBy(*order).limit(k) if k else out


def in_both(left: DataFrame, right: DataFrame, order: list[str], k: int | None = 3) -> DataFrame:
    columns = common_columns(left, right)
    out = left.select(*columns).intersectAll(right.select(*columns))
    return out.orderBy(*order).limit(k) if k else out


def schema_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, kind string")


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """A row for each column of either side: where it is, its kinds and whether they agree."""
    a, b = schema_rows(left).withColumnRenamed("kind", "left_kind"), schema_rows(right).withColumnRenamed("kind", "right_kind")
    state = F.when(F.col("left_kind").isNull(), "right_only").when(F.col("right_kind").isNull(), "left_only").when(F.col("left_kind") == F.col("right_kind"), "same").otherwise("type_differs")
    return a.join(b, "column", "full").select("column", "left_kind", "right_kind", state.alias("state"))


def schema_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    d = schema_diff(left, right)
    both = F.count_if(F.col("left_kind").isNotNull() & F.col("right_kind").isNotNull())
    most = F.greatest(F.count("left_kind"), F.count("right_kind"))
    return d.agg(both.alias("common"), F.count_if(F.col("state") == "type_differs").alias("type_differs"), F.round(both / most, 4).alias("similarity"))


def perturbed(df: DataFrame, column: str, key: str) -> DataFrame:
    """A second source for trials: one is added to a column in the max(1, min(n // 20, 10)) rows of least key."""
    n = df.agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    first = df.select(key).distinct().orderBy(key).limit(10).withColumn("_at", F.row_number().over(Window.orderBy(key)))
    out = df.join(F.broadcast(first), key, "left").join(F.broadcast(n))
    hit = F.col("_at") <= F.greatest(F.lit(1), F.least(F.floor(F.col("_n") / 20), F.lit(10)))
    return out.withColumn(column, F.when(hit, F.col(column) + 1).otherwise(F.col(column))).select(*df.columns)


def null_check(df: DataFrame, limit: float = 5.0) -> DataFrame:
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0))
    pct = F.coalesce(nulls * 100.0 / (F.count("*") * len(df.columns)), F.lit(0.0))
    return df.agg(F.lit("null_check").alias("rule"), F.round(pct, 4).alias("pct"), F.greatest(F.lit(0.0), 100 - pct).alias("score"), F.when(pct < limit, "PASS").otherwise("FAIL").alias("status"))


def duplicate_check(df: DataFrame, limit: float = 1.0) -> DataFrame:
    """Whole-row repeats beyond the first; nulls are equal to each other."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    pct = F.coalesce((F.sum("_n") - F.count("*")) * 100.0 / F.sum("_n"), F.lit(0.0))
    return groups.agg(F.lit("duplicate_check").alias("rule"), F.round(pct, 4).alias("pct"), F.greatest(F.lit(0.0), 100 - 10 * pct).alias("score"), F.when(pct < limit, "PASS").otherwise("FAIL").alias("status"))


def type_check(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns that hold more than one kind of value (whole number, fraction, flag, text)."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    def kind(c: str) -> Column:
        v = F.col(c)
        return F.when(v.rlike("^[+-]?[0-9]+$"), "int").when(v.rlike("^[+-]?[0-9]*[.][0-9]+$"), "float").when(F.lower(v).isin("true", "false"), "bool").when(v.isNotNull(), "text")

    mixed = sum(((F.count_distinct(kind(c)) > 1).cast("int") for c in columns), F.lit(0))
    score = F.when(mixed == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 20.0 * mixed))
    return df.agg(F.lit("data_type_check").alias("rule"), F.round(mixed * 1.0, 4).alias("pct"), score.alias("score"), F.when(mixed == 0, "PASS").otherwise("FAIL").alias("status"))


def quartiles(long: DataFrame) -> DataFrame:
    """column, q1, q3 and n of rows (column, v): exact, between two values in proportion.

    Distinct values are counted and range-sorted; only sums of partitions and the values around the quartiles are gathered, so
    no task holds a column.
    """
    counts = kept(long.groupBy("column", "v").agg(F.count("*").alias("n")).repartitionByRange("column", "v").sortWithinPartitions("column", "v").withColumn("part", F.spark_partition_id()))
    sums = counts.groupBy("column", "part").agg(F.sum("n").alias("size"))  # a row for each column and partition
    before = F.sum("size").over(Window.partitionBy("column").orderBy("part")) - F.col("size")
    base = sums.select("column", "part", before.alias("before"), F.sum("size").over(Window.partitionBy("column")).alias("total"))
    last = F.col("before") + F.sum("n").over(Window.partitionBy("column", "part").orderBy("v"))
    ranked = counts.join(base, ["column", "part"]).select("column", "v", "n", "total", last.alias("last"))
    at = {name: (F.col("total") - 1) * share for name, share in (("q1", 0.25), ("q3", 0.75))}

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("last") > rank) & (F.col("last") - F.col("n") <= rank), F.col("v")))

    near = ranked.groupBy("column").agg(F.max("total").alias("n"), *[value(f(r)).alias(f"{q}_{f.__name__}") for q, r in at.items() for f in (F.floor, F.ceil)])
    share = {q: (F.col("n") - 1) * s - F.floor((F.col("n") - 1) * s) for q, s in (("q1", 0.25), ("q3", 0.75))}
    return near.select("column", *[(F.col(f"{q}_floor") * (1 - share[q]) + F.col(f"{q}_ceil") * share[q]).alias(q) for q in ("q1", "q3")], "n")


def outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the quartiles and the share of values beyond 1.5 times their distance; columns whose quartiles meet have none."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    q = quartiles(long)
    far = (F.col("q3") > F.col("q1")) & ((F.col("v") < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    hits = long.join(F.broadcast(q), "column").groupBy("column").agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.count("*").alias("n"), F.count_if(far).alias("n_outliers"))
    return hits.select("column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), "n", "n_outliers", F.round(F.col("n_outliers") * 100.0 / F.col("n"), 4).alias("pct"))


def range_check(df: DataFrame, columns: list[str], limit: float = 5.0) -> DataFrame:
    """outliers as a rule: columns over the limit are issues; a warning, not a failure."""
    bad = F.count_if(F.col("pct") > limit)
    return outliers(df, columns).agg(F.lit("range_check").alias("rule"), (bad * 1.0).alias("pct"), F.greatest(F.lit(0.0), 100.0 - 15.0 * bad).alias("score"), F.when(bad == 0, "PASS").otherwise("WARNING").alias("status"))


#: The weight of each rule in the score, 1.0 for any other.
WEIGHTS = {"null_check": 1.0, "duplicate_check": 0.8, "data_type_check": 0.9, "range_check": 0.6}
RULES: dict[str, Callable[..., DataFrame]] = {"null_check": null_check, "duplicate_check": duplicate_check, "data_type_check": type_check, "range_check": range_check}


def apply_rules(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """A row for each rule; rules that are not known are skipped with score 0."""
    out = None
    for name, options in rules.items():
        row = RULES[name](df, **options) if name in RULES else df.sparkSession.createDataFrame([(name, 0.0, 0.0, "SKIPPED")], "rule string, pct double, score double, status string")
        row = row.select("rule", F.col("pct").cast("double").alias("pct"), F.round(F.col("score").cast("double"), 4).alias("score"), "status")
        out = row if out is None else out.unionByName(row)
    return out


def weighted_score(results: DataFrame) -> DataFrame:
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("rule")], F.lit(1.0))
    return results.agg(F.round(F.sum(F.col("score") * weight) / F.sum(weight), 2).alias("quality_score"))


def table_quality(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """0.4 * filled + 0.3 * not repeated + 0.3 * mean share of distinct texts, between 0 and 1; 0 for no rows."""
    n, cells = F.sum("_n"), len(df.columns)
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    nulls = sum((F.sum(F.col(c).isNull().cast("long") * F.col("_n")) for c in df.columns), F.lit(0)) / (n * cells)
    repeats = (n - F.count("*")) / n
    shares = [F.coalesce(F.count_distinct(c) / F.sum(F.col(c).isNotNull().cast("long") * F.col("_n")), F.lit(0.0)) for c in text_columns]
    mean = sum(shares, F.lit(0.0)) / len(shares) if shares else F.lit(1.0)
    score = 0.4 * (1 - nulls) + 0.3 * (1 - repeats) + 0.3 * mean
    return groups.agg(F.round(F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 4).alias("quality"))
