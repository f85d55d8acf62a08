"""Metrics, alerts, servers and caches in batch form; streaming/ has the same over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alerts(metrics: DataFrame, limits: DataFrame, name: str, value: str) -> DataFrame:
    """Rows at or above their metric's warning or critical limit, with the severity; limits has one row a metric."""
    from ..functions.scoring import severity

    out = metrics.join(limits.withColumnRenamed("metric", name), name).withColumn("severity", severity(F.col(value), F.col("warning"), F.col("critical")))
    return out.where("severity is not null").drop("warning", "critical")


RANK = {"critical": 2, "warning": 1}


def overall(alerts_: DataFrame, *keys: str) -> DataFrame:
    """critical if any alert is, else warning if any is, else healthy."""
    from ..functions.scoring import mapped

    worst = F.max(mapped(F.col("severity"), RANK, 0))
    return alerts_.groupBy(*keys).agg(F.when(worst == 2, "critical").when(worst == 1, "warning").otherwise("healthy").alias("status"), F.count("severity").alias("n_alerts"))


def breaker_states(calls: DataFrame, keys: list[str], order: list[str], failed: Column, threshold: int) -> DataFrame:
    """Adds the length of the run of failures that ends at each call, and whether the breaker is open after it."""
    from .ordered import islands

    bad = F.coalesce(failed, F.lit(False))
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(calls.withColumn("_bad", bad), keys, order, ~F.col("_bad") | ~F.coalesce(F.lag("_bad").over(w), F.lit(True)), "_run")
    n = F.sum(F.col("_bad").cast("int")).over(Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("failures_in_row", n).withColumn("open", F.col("failures_in_row") >= threshold).drop("_bad", "_run")


def least_loaded(servers: DataFrame, keys: list[str], load: str, name: str) -> DataFrame:
    """The server of least load of each group, least name on ties."""
    return servers.groupBy(*keys).agg(F.min_by(name, F.struct(load, name)).alias(name))


def cache_state(access: DataFrame, key: str, ts: str, ttl: str, capacity: int) -> DataFrame:
    """Keys with their last use; expired after ttl before the newest use, evicted if more than ``capacity`` live keys are newer."""
    last = access.groupBy(key).agg(F.max(ts).alias("last_use"), F.count("*").alias("n"))
    newest = last.agg(F.max("last_use").alias("_now"))
    out = last.join(F.broadcast(newest)).withColumn("expired", F.col("last_use") <= F.expr(f"_now - interval {ttl}"))
    kept = out.where("not expired").orderBy(F.desc("last_use"), key).limit(capacity).select(key, F.lit(True).alias("_kept"))
    return out.join(kept, key, "left").select(key, "last_use", "n", "expired", (~F.col("expired") & F.col("_kept").isNull()).alias("evicted"))
