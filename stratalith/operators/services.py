"""Servers, uploads, answers in pieces, layouts against tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose(requests: DataFrame, servers: DataFrame, key: str, order: str, tokens: str, heavy: int = 2000) -> DataFrame:
    """(order, server): heavy requests go to the least loaded server of their group, the others to the group's servers in turn.

    servers: key, server, active; a group has few servers, requests may be many and are numbered within their group.
    """
    ranked = servers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("active", "server"))).alias("_by_load"), F.array_sort(F.collect_list("server")).alias("_names"))
    light = F.col(tokens) <= heavy
    turn = F.sum(light.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    out = requests.withColumn("_turn", turn).join(ranked, key, "left")
    return out.select(key, order, F.when(light, F.element_at("_names", (F.pmod(F.col("_turn"), F.size("_names")) + 1).cast("int"))).otherwise(F.col("_by_load")[0]["server"]).alias("server"))


def hit_rate(log: DataFrame, hit: Column, *keys: str) -> DataFrame:
    """Look-ups, hits and hits in per cent of max(1, look-ups)."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("hit_pct", F.round(F.col("hits") * 100.0 / F.greatest(F.lit(1), F.col("n")), 4))


def new_part(answers: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """What each version of an answer adds to the one before, if it begins with it; else all of it."""
    before = F.coalesce(F.lag(text).over(Window.partitionBy(*keys).orderBy(order)), F.lit(""))
    return answers.withColumn("_b", before).withColumn("delta", F.when(F.startswith(F.col(text), F.col("_b")), F.substr(F.col(text), F.length("_b") + 1)).otherwise(F.col(text))).drop("_b")


def layout_match(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """Fields of a layout (name, sql_type) against columns of a table (name, sql_type), names brought to one form."""
    def form(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.upper(F.replace("name", F.lit("-"), F.lit("_"))).alias("name"), F.col("sql_type").alias(kind))

    out = form(fields, "layout_type").join(form(columns, "table_type"), "name", "full")
    state = F.when(F.col("table_type").isNull(), "layout_only").when(F.col("layout_type").isNull(), "table_only").when(F.col("layout_type") == F.col("table_type"), "match").otherwise("type_differs")
    return out.withColumn("state", state)


def redefined(items: DataFrame, key: str) -> DataFrame:
    """For each field that others redefine, those in order; items: name, redefines, line."""
    rows = items.where("redefines is not null").groupBy(key, "redefines").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("x"))
    return rows.select(key, F.col("redefines").alias("original"), F.array_join(F.transform("x", lambda s: s["name"]), ",").alias("variants"), F.size("x").alias("n"))


def technical_specs(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Lines and words that matter of each source, without a shuffle."""
    from ..functions.scoring import word_count

    t = F.col(text)
    return sources.select(key, F.size(F.split(t, "\n")).alias("n_lines"), word_count(t, "SELECT", "INSERT", "UPDATE", "DELETE").alias("n_sql"), word_count(t, "PERFORM").alias("n_perform"), word_count(t, "IF").alias("n_if"))


def direction(explicit: Column, access: Column) -> Column:
    """How data go between a file and DB2: as marked, else by whether the file is read."""
    return F.when(explicit.isNotNull(), explicit).when(access == "READ", "db2_to_file").otherwise("file_to_db2")


#: What each measure of a device adds to its score for a unit, and the levels that power, processes and success are measured from.
DEVICE_WEIGHTS = {"free_gb": 25, "idle_percent": 0.8, "degrees_below_100": 0.3, "free_slots": 15, "processes_below_20": 2, "allocation_success": 0.1, "watts_below_400": 0.05, "success_over_50": 0.2, "priority": 2}
DEVICE_NOT_FIRST = 20


def device_score(free_gb: Column, utilization: Column, temperature: Column, workloads: Column, most_workloads: Column, processes: Column, allocation_success: Column, watts: Column, kind_success: Column, priority: Column, number: Column) -> Column:
    """How well a device suits a piece of work, 0 at least; kind_success: share of such work that went well there, null if it never had any."""
    w = DEVICE_WEIGHTS
    parts = (
        free_gb * w["free_gb"] + (100 - utilization) * w["idle_percent"] + (100 - temperature) * w["degrees_below_100"] + (most_workloads - workloads) * w["free_slots"]
        + F.greatest(F.lit(0), (20 - processes) * w["processes_below_20"]) + allocation_success * w["allocation_success"] + F.when(watts > 0, F.greatest(F.lit(0.0), (400 - watts) * w["watts_below_400"])).otherwise(0.0)
        + F.coalesce((kind_success - 50) * w["success_over_50"], F.lit(0.0)) + priority * w["priority"] + F.when(number > 0, DEVICE_NOT_FIRST).otherwise(0))
    return F.greatest(F.lit(0.0), parts)
