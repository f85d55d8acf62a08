"""Report aggregations over components, their operations and their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_set(column: str) -> Column:
    """The distinct values of a column, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",")


def shared_targets(ops: DataFrame, target: str, component: str, *kinds: str, least: int = 2) -> DataFrame:
    """Targets that at least ``least`` components work on: how many, how often, and the values of ``kinds``."""
    return ops.groupBy(target).agg(
        F.count_distinct(component).alias("n_components"), F.count("*").alias("n_operations"), *[joined_set(k).alias(f"{k}_set") for k in kinds]
    ).where(F.col("n_components") >= least)


def component_summary(components: DataFrame, ops: DataFrame, fields: DataFrame, key: str, op: str, field: str, exact: bool = True) -> DataFrame:
    """Operations and fields of every component, those without any included.

    exact: each side is counted before the join.  Otherwise the sides are
    joined first, so operations are counted once for each field row; this
    multiplies rows within a component and is kept for comparison only.
    """
    if exact:
        ops = ops.groupBy(key).agg(F.count("*").alias("n_operations"), F.count_distinct(op).alias("n_kinds"))
        fields = fields.groupBy(key).agg(F.count_distinct(field).alias("n_fields"))
        out = components.select(key).join(ops, key, "left").join(fields, key, "left")
        return out.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_operations", "n_kinds", "n_fields")])
    out = components.select(key).join(ops.select(key, op), key, "left").join(fields.select(key, field), key, "left")
    return out.groupBy(key).agg(F.count(op).alias("n_operations"), F.count_distinct(op).alias("n_kinds"), F.count_distinct(field).alias("n_fields"))


def never_used(defined: DataFrame, used: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``defined`` whose keys do not occur in ``used``; null keys count as not used."""
    return defined.join(used.select(*keys).distinct(), list(keys), "left_anti")


def lifecycle(ops: DataFrame, key: str, order: list[str], step: str) -> DataFrame:
    """The steps of each key in order, as one text, with their number and how many differ."""
    steps = F.array_sort(F.collect_list(F.struct(*order, step)))
    return ops.groupBy(key).agg(F.count("*").alias("n_steps"), F.count_distinct(step).alias("n_kinds"), F.array_join(F.transform(steps, lambda s: s[step].cast("string")), ">").alias("steps"))


def success_rate(log: DataFrame, good: Column, *keys: Column, value: str) -> DataFrame:
    """Calls, share of good ones in per cent and mean of a value, by keys."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.when(good, 100.0).otherwise(0.0)), 4).alias("success_pct"), F.round(F.avg(value), 4).alias(f"avg_{value}"))


def since(log: DataFrame, ts: str, interval: str) -> DataFrame:
    """Rows of the last interval before the newest row; the newest time is one number, found by an aggregate."""
    newest = log.agg(F.max(ts).alias("_newest"))
    return log.join(F.broadcast(newest), F.col(ts) > F.expr(f"_newest - interval {interval}")).drop("_newest")


def buckets(values: DataFrame, value: str, *bounds: float) -> DataFrame:
    """One row: how many values lie at or above each bound but below the one before, from high to low, and below the last."""
    tops = (None, *bounds)
    cols, v = [], F.col(value)
    for upper, lower in zip(tops, bounds, strict=False):
        hit = (v >= lower) if upper is None else (v >= lower) & (v < upper)
        cols.append(F.count_if(hit).alias(f"from_{lower:g}"))
    return values.agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), *cols, F.count_if(v < bounds[-1]).alias("rest"))


def activity(pairs: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """The k names that occur in most pairs; a pair of a name with itself counts once."""
    names = pairs.select(F.explode(F.array_distinct(F.array(F.col(a).cast("string"), F.col(b).cast("string")))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def trends(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, extremes and how many lie above mean + (max - mean) / 2, by keys."""
    stats = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
    limit = F.col("mean") + (F.col("max") - F.col("mean")) / 2
    high = values.join(stats, list(keys)).where(F.col(value) > limit).groupBy(*keys).agg(F.count("*").alias("n_high"))
    return stats.join(high, list(keys), "left").select(*keys, F.round("mean", 4).alias("mean"), "max", "min", F.coalesce("n_high", F.lit(0)).alias("n_high"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """An upsert's result: of the rows of each key the first by order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
