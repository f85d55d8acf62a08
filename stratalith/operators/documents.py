"""Facts gathered into one row a component, and the documents that are filled from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strongest(edges: DataFrame, keys: list[str], confidence: str, order: list[str]) -> DataFrame:
    """Of edges with equal keys the one of greatest confidence, the first by order on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(confidence), *order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def program_facts(chunks: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """Chunks, kinds and characters of each program."""
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("kinds"), F.sum(F.length(text)).alias("n_chars"))


def program_document(facts: DataFrame, key: str) -> DataFrame:
    """A program's page, filled from its facts."""
    text = F.format_string("Program %s\nChunks: %d\nKinds: %s\nSize: %d characters", F.col(key).cast("string"), "n_chunks", "kinds", "n_chars")
    return facts.select(key, text.alias("document"))


def plan_phases(rows: DataFrame, risk: Column, downstream: Column) -> DataFrame:
    """The phase of each component: low risk with more than two users first, high risk last."""
    return rows.withColumn("phase", F.when((risk == "LOW") & (downstream > 2), 1).when(risk == "HIGH", 3).otherwise(2))


def priorities(rows: DataFrame, key: str, risk: Column, downstream: Column, k: int = 5) -> DataFrame:
    """The k components of greatest risk rank plus number of users."""
    rank = F.when(risk == "HIGH", 3).when(risk == "MEDIUM", 2).otherwise(1)
    return rows.select(key, (rank + downstream).alias("priority")).orderBy(F.desc("priority"), key).limit(k)


def found(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows one of whose columns contains a text, whatever the case; marks of LIKE have no meaning."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return rows.where(hit)


def filtered(rows: DataFrame, status: str | None = None, newer: tuple[str, str] | None = None, name: tuple[str, str] | None = None) -> DataFrame:
    """Results by status, age before the newest row (column, interval) and part of a name (column, text)."""
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if newer:
        from .reports import since

        rows = since(rows, *newer)
    return found(rows, [name[0]], name[1]) if name else rows


def combined(parts: DataFrame, keys: list[str], order: str, text: str, ok: Column) -> DataFrame:
    """The parts of one answer put together: how many came and failed, and the texts that came in order."""
    texts = F.array_sort(F.collect_list(F.when(ok, F.struct(order, text))))
    return parts.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.array_join(F.transform(texts, lambda x: x[text].cast("string")), " ").alias("text"))


def padding(fields: DataFrame, key: str, size: str, sync: Column) -> DataFrame:
    """What fillers of a layout are for, and how much room they take."""
    g = fields.groupBy(key).agg(F.max(sync.cast("int")).alias("s"), F.max((F.col(size) % 4 == 0).cast("int")).alias("w"), F.max(size).alias("m"), F.sum(size).alias("total"))
    use = F.when(F.col("s") == 1, "hardware_alignment").when(F.col("w") == 1, "word_boundary").when(F.col("m") > 100, "padding").otherwise("filler")
    return g.select(key, use.alias("purpose"), F.when(F.col("total") > 1000, "high").when(F.col("total") > 100, "medium").otherwise("low").alias("waste"), "total")


def stages(ops: DataFrame, key: str, op: Column) -> DataFrame:
    """How often each lifecycle stage occurs for a key, and how complete its lifecycle is."""
    from ..functions.scoring import STAGE_OF, completeness, mapped

    rows = ops.select(key, mapped(op, STAGE_OF, "other").alias("stage"))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("stage")).alias("s")).select(key, "n", F.array_join("s", ",").alias("stages"), F.round(completeness(F.col("s")), 4).alias("completeness"))
