"""Facts of fields, findings of components, averages of metrics, work that reports its own failures, chunks of layouts and jobs.

Edge cases: components without any facts get the general sentence; null names are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import by_value
from .reports import since

#: Fixed value: what is said of a component of which nothing else can be said.
GENERAL = "Analysis completed with comprehensive component assessment"


def field_facts(uses: DataFrame, field: str, program: str, operation: str, used: str, recent: int = 5) -> DataFrame:
    """For each field: how many uses, its programs and operations (sorted), and its newest uses as program:operation, the newest first, at most ``recent``."""
    rows = uses.select(F.col(field).alias("field"), F.col(program).cast("string").alias("p"), F.col(operation).cast("string").alias("o"), F.col(used).alias("at")).where("field is not null")
    newest = rows.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy(F.desc_nulls_last("at"), "p", "o"))).where(F.col("n") <= recent)
    newest = newest.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", "p", "o").alias("t")))).alias("r")).select("field", F.col("r.t").alias("recent"))
    pairs = rows.groupBy("field", "p", "o").agg(F.count("*").alias("n"), F.max("at").alias("at"))  # sets are of pairs, not of uses
    facts = pairs.groupBy("field").agg(F.sum("n").alias("uses"), F.array_sort(F.collect_set("p")).alias("programs"), F.array_sort(F.collect_set("o")).alias("operations"), F.max("at").alias("last_used"))
    return facts.join(newest, "field")


def findings(components: DataFrame, calls: DataFrame, access: DataFrame) -> DataFrame:
    """name and summary: the lines that an executive summary of each component (column name) consists of.

    calls: calling and called; access: file and program.  Distinct partners count; those that call are upstream, those
    called downstream.
    """
    pairs = calls.select(F.col("calling").cast("string").alias("a"), F.col("called").cast("string").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    out, into = (pairs.groupBy(F.col(c).alias("name")).agg(F.sum("n").alias(f"{x}_calls"), F.count("*").alias(x)) for c, x in (("a", "down"), ("b", "up")))
    users = access.select(F.col("file").cast("string").alias("name"), "program").distinct().groupBy("name").agg(F.count("*").alias("users"))
    rows = components.select(F.col("name").cast("string").alias("name")).where("name is not null").distinct()
    for facts in (out, into, users):
        rows = rows.join(facts, "name", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("down", "up", "down_calls", "up_calls")}
    called = F.col("down").isNotNull() | F.col("up").isNotNull()
    lines = F.array(
        F.when(called, F.format_string("Program Integration: %d outbound calls, %d inbound calls", n["down_calls"], n["up_calls"])), F.when(F.col("users").isNotNull(), F.format_string("Data Flow: Accessed by %d programs", "users")),
        F.when(called, F.format_string("Lineage Impact: %d upstream dependencies, %d downstream impacts", n["up"], n["down"])))
    text = F.array_join(F.array_compact(lines), "\n")
    return rows.select("name", F.when(text == "", GENERAL).otherwise(text).alias("summary"))


def averages(metrics: DataFrame, name: str, value: str, ts: str, hours: int = 6) -> DataFrame:
    """The mean of each metric over the last hours before the newest time, values that are no numbers left out; 0 for metrics without any."""
    recent = since(metrics, ts, f"{hours} hours").groupBy(name).agg(F.avg(F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))).alias("average"), F.count("*").alias("n"))
    return metrics.select(name).distinct().join(recent, name, "left").select(name, F.coalesce("average", F.lit(0.0)).alias("average"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def attempted(rows: DataFrame, key: str, work: Callable[[dict], object], seconds: float | None = None) -> DataFrame:
    """Applies a function to each row (a dict) in the tasks: key, status (success or error), result (as text) and error.

    work goes to the tasks as Python pickles it: by name if its module can be imported, which executors must be able to do then.
    A failing row, one whose result is None, and one that takes longer than the given seconds (told when it ends) is a row with
    its error; others go on.
    """
    import time

    by_value(__name__)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                began, result, error = time.monotonic(), None, None
                try:
                    result = work(row)
                    error = "no result" if result is None else None
                except Exception:  # noqa: BLE001  a row's failure is its result
                    error = traceback.format_exc(limit=0).strip().splitlines()[-1]
                if seconds is not None and error is None and time.monotonic() - began > seconds:
                    result, error = None, "timeout"
                out.append((row[key], "error" if error else "success", None if error else str(result), error))
            yield pd.DataFrame(out, columns=["key", "status", "result", "error"])

    return rows.mapInPandas(run, f"key {kind}, status string, result string, error string").withColumnRenamed("key", key)


def batch_report(results: DataFrame) -> DataFrame:
    """One row: n, succeeded, failed, the share that succeeded in percent, and the most frequent error."""
    kinds = results.groupBy("status", "error").agg(F.count("*").alias("k"))
    total, good = F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("k"))), F.lit(0))
    out = kinds.agg(total.alias("n"), good.alias("succeeded"), F.max(F.when(F.col("error").isNotNull(), F.struct("k", "error"))).alias("most"))
    share = F.round(100 * F.col("succeeded") / F.greatest(F.col("n"), F.lit(1)), 2)
    return out.select("n", "succeeded", (F.col("n") - F.col("succeeded")).alias("failed"), share.alias("success_rate"), F.col("most.error").alias("common_error"))


def layout_chunks(lines: DataFrame, key: str, at: str, text: str, size: int = 3000, fields: int = 2) -> DataFrame:
    """Lines of layouts in chunks: key, chunk, first, last (lines), n_chars, n_fields.

    A chunk ends before the line with which it would be longer than ``size`` characters (each line with its end), if it has at
    least so many fields, that is lines that begin with a level number.  A fold over the lines of a layout, which is one source.
    """
    is_field = F.col(text).rlike(r"^\s*\d{2}\s+\S")
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).cast("int").alias("at"), (F.length(text) + 1).alias("size"), is_field.cast("int").alias("field")))).alias("x"))
    state = "struct<chunk:int,size:int,fields:int,out:array<struct<at:int,chunk:int,size:int,field:int>>>"

    def put(s: Column, x: Column) -> Column:
        new = (s["size"] + x["size"] > size) & (s["fields"] >= fields)
        chunk = F.when(new, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["size"]).otherwise(s["size"] + x["size"]).alias("size"), F.when(new, x["field"]).otherwise(s["fields"] + x["field"]).alias("fields"),
                        F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), chunk.alias("chunk"), x["size"].alias("size"), x["field"].alias("field")))).alias("out")).cast(state)

    begin = F.struct(F.lit(1).alias("chunk"), F.lit(0).alias("size"), F.lit(0).alias("fields"), F.array().cast("array<struct<at:int,chunk:int,size:int,field:int>>").alias("out")).cast(state)
    rows = rows.select(key, F.explode(F.aggregate("x", begin, put, lambda s: s["out"])).alias("o")).select(key, "o.*")
    return rows.groupBy(key, "chunk").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("size").alias("n_chars"), F.sum("field").alias("n_fields"))
