"""Sources in sections and chunks of lines, definitions, graphs around components, usage chains and merged online facts.

Edge cases: null and empty sources have no chunks.  A line longer than a limit is a chunk of its own.  Blank chunks are left
out.  Ties are broken by names, so that what a cap leaves does not depend on the order of rows; caps tell how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .program import tidy

#: Lines of a chunk of a source of unknown kind, and of one that could not be parsed.
GENERIC, RECOVERY = 50, 30
TOKENS, LINES = 1000, 60
NAME = "[A-Z0-9][A-Z0-9-]*"


def tokens(text: Column) -> Column:
    """About how many tokens a text has: one for four characters."""
    return F.floor(F.length(text) / 4).cast("int")


def _lines(sources: DataFrame, key: str, text: str, clean: bool = False) -> DataFrame:
    body = tidy(F.col(text)) if clean else F.coalesce(F.col(text), F.lit(""))
    return sources.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.posexplode(F.split(body, "\n")).alias("_i", "_x"))


def fixed_chunks(sources: DataFrame, key: str, text: str, size: int = GENERIC) -> DataFrame:
    """Chunks of so many lines: key, chunk, first, last, content."""
    rows = _lines(sources, key, text).groupBy("_key", (F.floor(F.col("_i") / size) + 1).cast("int").alias("chunk"))
    out = rows.agg(F.min("_i").alias("a"), F.max("_i").alias("b"), F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("p"))
    out = out.withColumn("content", F.array_join(F.col("p._x"), "\n")).where("trim(translate(content, '\n\t\r', '   ')) <> ''")
    return out.select(F.col("_key").alias(key), "chunk", (F.col("a") + 1).alias("first"), (F.col("b") + 1).alias("last"), "content")


def packed(rows: DataFrame, keys: list[str], at: str, weight: Column, limit: int, most: int | None = None, whole: bool = False) -> DataFrame:
    """Rows in order with their chunk, all columns kept; a chunk ends before the row with which its weight would pass the limit, or after so many rows.

    whole: rows of a key that weigh no more than the limit together are one chunk, however many they are.  A fold over the rows of
    a key, which are the lines of one text; it takes the columns along, so that nothing is joined.
    """
    rest = [c for c in rows.columns if c not in keys and c != at]
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(at), weight.cast("int").alias("_w"), *rest))).alias("_r"))
    state = "struct<chunk:int,w:long,n:int,out:array<int>>"

    def put(s: Column, x: Column) -> Column:
        new = (s["n"] > 0) & ((s["w"] + x > limit) | (F.lit(False) if most is None else s["n"] >= most))
        chunk = F.when(new, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x).otherwise(s["w"] + x).alias("w"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(chunk)).alias("out")).cast(state)

    begin = F.struct(F.lit(1).alias("chunk"), F.lit(0).alias("w"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")).cast(state)
    weights = F.col("_r._w")
    chunks = F.aggregate(weights, begin, put, lambda s: s["out"])
    if whole:
        chunks = F.when(F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x) <= limit, F.array_repeat(F.lit(1), F.size("_r"))).otherwise(chunks)
    each = F.arrays_zip(F.col("_r").alias("r"), chunks.alias("c"))
    return held.select(*keys, F.explode(each).alias("_z")).select(*keys, *(F.col(f"_z.r.{c}").alias(c) for c in (at, *rest)), F.col("_z.c").alias("chunk"))


def token_chunks(sources: DataFrame, key: str, text: str, budget: int = 600, instructions: int = 400) -> DataFrame:
    """Lines as chunks within a budget of tokens that instructions have a share in: key, chunk, first, last, n_tokens."""
    lines = _lines(sources, key, text).select("_key", "_i", tokens(F.col("_x")).alias("_t"))
    found = packed(lines, ["_key"], "_i", F.col("_t"), budget - instructions)
    return found.groupBy("_key", "chunk").agg((F.min("_i") + 1).alias("first"), (F.max("_i") + 1).alias("last"), F.sum("_t").alias("n_tokens")).withColumnRenamed("_key", key)


def sections(sources: DataFrame, key: str, text: str, budget: int = TOKENS, lines: int = LINES) -> DataFrame:
    """COBOL in sections: key, type (DIVISION, SECTION, PARAGRAPH or CHUNK), name, part, first, last, n_tokens.

    A section goes to the line before the next boundary; what stands before the first one, or a source without any, is a CHUNK.
    Sections over the budget are cut into parts of at most so many tokens and lines.
    """
    rows = _lines(sources, key, text, clean=True)
    u = F.upper("_x")
    above = F.last(F.when(F.trim("_x") != "", F.rtrim("_x")), ignorenulls=True).over(Window.partitionBy("_key").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    patterns = (("DIVISION", rf"^\s*({NAME})\s+DIVISION\b"), ("SECTION", rf"^\s*({NAME})\s+SECTION\s*\."), ("PARAGRAPH", rf"^ {{0,7}}(?!END-|EXIT\s*\.|GOBACK\s*\.|STOP\s*\.|CONTINUE\s*\.|ELSE\s*\.)({NAME})\s*\.\s*$"))
    found = F.lit(None).cast("struct<type:string,name:string>")
    for kind, pattern in reversed(patterns):
        test = u.rlike(pattern) & (F.endswith(F.coalesce(F.col("_above"), F.lit(".")), F.lit(".")) if kind == "PARAGRAPH" else F.lit(True))
        found = F.when(test, F.struct(F.lit(kind).alias("type"), F.regexp_extract(u, pattern, 1).alias("name"))).otherwise(found)
    order = Window.partitionBy("_key").orderBy("_i")
    rows = rows.withColumn("_above", above).withColumn("_b", found).withColumns({"_n": F.count_if(F.col("_b").isNotNull()).over(order), "_s": F.last("_b", ignorenulls=True).over(order), "_t": tokens(F.col("_x"))})
    rows = rows.select("_key", "_n", "_i", "_s", "_t", (F.trim("_x") != "").alias("_some"))
    rows = packed(rows, ["_key", "_n"], "_i", F.col("_t"), budget, lines, whole=True).withColumnRenamed("chunk", "_c")
    out = rows.groupBy("_key", "_n", "_c").agg(F.first("_s").alias("s"), (F.min("_i") + 1).alias("first"), (F.max("_i") + 1).alias("last"), F.sum("_t").alias("n_tokens"), F.max("_some").alias("some")).where("some")
    return out.select(F.col("_key").alias(key), F.coalesce("s.type", F.lit("CHUNK")).alias("type"), F.coalesce("s.name", F.lit("")).alias("name"), F.col("_c").alias("part"), "first", "last", "n_tokens")


def definitions(items: DataFrame, key: str) -> DataFrame:
    """A lineage row for the definition of each field of a layout: program, field, operation, data_type, line; items as extract.data_items gives them."""
    return items.where("level <> 88 and name <> 'FILLER'").select(F.col(key).alias("program"), F.col("name").alias("field"), F.lit("definition").alias("operation"), F.coalesce("sql_type", F.lit("group")).alias("data_type"), "line")


def stage(text: Column) -> Column:
    """Where a source stands in its life: ACTIVE with an identification, COMPLETE with an end alone, else PROCESSING."""
    u = F.upper(F.coalesce(text, F.lit("")))
    return F.when(F.contains(u, F.lit("IDENTIFICATION DIVISION")), "ACTIVE").when(F.contains(u, F.lit("END PROGRAM")), "COMPLETE").otherwise("PROCESSING")


def around(impacts: DataFrame, most: int = 5) -> DataFrame:
    """The graph around each component: a row for each edge, component, side (upstream or downstream), neighbour, relationship, rank, n_side, n_nodes and complexity.

    impacts: source, dependent and relationship.  Of each side the first neighbours by name are told; n_side counts all, n_nodes
    the nodes told, the component included; complexity is high above ten nodes, medium above five.
    """
    pairs = impacts.where("source is not null and dependent is not null and source <> dependent").groupBy("source", "dependent").agg(F.min("relationship").alias("relationship"))
    both = pairs.select(F.col("dependent").alias("component"), F.lit("upstream").alias("side"), F.col("source").alias("neighbour"), "relationship").union(pairs.select("source", F.lit("downstream"), "dependent", "relationship"))
    side = Window.partitionBy("component", "side")
    few = both.withColumns({"rank": F.row_number().over(side.orderBy("neighbour")), "n_side": F.count("*").over(side)}).where(F.col("rank") <= most)
    n = F.count("*").over(Window.partitionBy("component")) + 1
    return few.withColumn("n_nodes", n).withColumn("complexity", F.when(F.col("n_nodes") > 10, "high").when(F.col("n_nodes") > 5, "medium").otherwise("low"))


def usage_chain(uses: DataFrame, file: str, program: str, operation: str, line: str) -> DataFrame:
    """Who uses each file, in order of program and line: file, position, program, operation, line."""
    at = F.row_number().over(Window.partitionBy(file).orderBy(program, line, operation))
    return uses.select(F.col(file).alias("file"), at.alias("position"), F.col(program).alias("program"), F.col(operation).alias("operation"), F.col(line).alias("line"))


def merged_online(analyses: DataFrame, key: str, purpose: str, resource: str, function: str) -> DataFrame:
    """Analyses of a program's online chunks as one: distinct purposes, resources and functions (sorted), and a complexity by the number of purposes."""
    out = analyses.groupBy(key).agg(*(F.array_sort(F.collect_set(c)).alias(n) for n, c in (("transaction_patterns", purpose), ("resource_types", resource), ("business_functions", function))))
    return out.withColumn("complexity", F.when(F.size("transaction_patterns") > 3, "high").otherwise("medium"))


def search_metrics(metrics: DataFrame, name: str, text: str) -> DataFrame:
    """Metrics whose operation has a text in it, whatever the case."""
    return metrics.where(F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(text.lower())))
