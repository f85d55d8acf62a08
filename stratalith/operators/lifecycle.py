"""What happens to data over their life: operations, stages, places of definition, dependencies, CICS and DB2 facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of each lifecycle operation, the stage of each, and sections with what stands in them.
OPERATIONS = {
    "CREATE": (r"OPEN\s+OUTPUT", r"WRITE\s+.*INVALID"), "READ": (r"OPEN\s+INPUT", r"(?<!RE)READ\s+\w+", r"SELECT\s+.*FROM"), "UPDATE": ("REWRITE", r"UPDATE\s+.*SET"), "DELETE": (r"DELETE\s+\w+",),
}
STAGES = {"CREATE": "creation", "READ": "read_operations", "UPDATE": "update_operations", "DELETE": "update_operations"}
SECTIONS = (
    ("WORKING-STORAGE SECTION", "WORKING-STORAGE", "data_definition"), ("FILE SECTION", "FILE-SECTION", "file_record_definition"), ("LINKAGE SECTION", "LINKAGE-SECTION", "parameter_definition"),
    ("LOCAL-STORAGE SECTION", "LOCAL-STORAGE", "local_data_definition"), ("PROCEDURE DIVISION", "PROCEDURE-DIVISION", "procedure_logic"),
)
FIELD_OPERATIONS = (
    ("READ", r"MOVE\s+([\w-]+)\s+TO"), ("READ", r"(?<!-)IF\s+([\w-]+)"), ("WRITE", r"MOVE\s+\S+\s+TO\s+([\w-]+)"), ("WRITE", r"COMPUTE\s+([\w-]+)"),
    ("UPDATE", r"ADD\s+\S+\s+TO\s+([\w-]+)"), ("UPDATE", r"SUBTRACT\s+\S+\s+FROM\s+([\w-]+)"), ("DEFINE", r"(?m)^\s*\d+\s+([A-Z][\w-]*)"),
)


def file_operations(sources: DataFrame, key: str, text: str) -> DataFrame:
    """How often each lifecycle operation occurs in a source, with its stage: key, operation, stage, n."""
    u = F.upper(F.coalesce(F.col(text), F.lit("")))
    counts = F.array(*[F.struct(F.lit(op).alias("operation"), F.lit(STAGES[op]).alias("stage"), sum((F.regexp_count(u, F.lit(p)) for p in patterns), F.lit(0)).alias("n")) for op, patterns in OPERATIONS.items()])
    return sources.select(key, F.explode(counts).alias("c")).select(key, "c.*").where("n > 0")


def field_operations(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Which operations each field of a source takes part in: key, field, operation, n; names that are no fields are left out."""
    from ..functions.names import valid_field

    u = F.upper(F.coalesce(F.col(text), F.lit("")))

    def of(operation: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(u, F.lit(pattern), F.lit(1)), lambda m: F.struct(m.alias("field"), F.lit(operation).alias("operation")))

    found = F.flatten(F.array(*[of(*x) for x in FIELD_OPERATIONS]))
    rows = sources.select(key, F.explode(found).alias("f")).select(key, "f.*").where(valid_field(F.col("field")))
    return rows.groupBy(key, "field", "operation").agg(F.count("*").alias("n"))


def located(sources: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """For each line that a pattern is found in: key, line, the section it stands in and what that is for."""
    lines = sources.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "x"))
    section = F.when(F.lit(False), "")
    for head, name, _ in SECTIONS:
        section = section.when(F.contains(F.upper("x"), F.lit(head)), name)
    w = Window.partitionBy(key).orderBy("at")
    rows = lines.withColumn("location", F.coalesce(F.last(section, ignorenulls=True).over(w), F.lit("UNKNOWN"))).where(F.col("x").rlike(pattern))
    use = F.when(F.lit(False), "")
    for _, name, meaning in SECTIONS:
        use = use.when(F.col("location") == name, meaning)
    return rows.select(key, (F.col("at") + 1).alias("line"), "location", use.otherwise("unknown").alias("usage_context"))


def dependencies(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct programs called and data sets named by a source: key, dependency, kind."""
    u = F.upper(F.coalesce(F.col(text), F.lit("")))
    called = F.transform(F.regexp_extract_all(u, F.lit("CALL\\s+['\"]([^'\"]+)['\"]"), F.lit(1)), lambda m: F.struct(m.alias("dependency"), F.lit("program").alias("kind")))
    named = F.transform(F.regexp_extract_all(u, F.lit(r"DSN=([^\s,]+)"), F.lit(1)), lambda m: F.struct(m.alias("dependency"), F.lit("dataset").alias("kind")))
    return sources.select(key, F.explode(F.concat(called, named)).alias("d")).select(key, "d.*").distinct()


def online_facts(found: DataFrame, key: str) -> DataFrame:
    """The CICS and DB2 life of each program, from its facts: commands, their programs and tables, and what they do to data."""
    command = F.upper("a")
    cics, sql = F.col("kind") == "cics", F.col("kind") == "sql"
    table = F.nullif(F.upper(F.regexp_extract("b", r"(?i)\b(?:FROM|INTO|UPDATE|TABLE)\s+(?!:)([A-Z][A-Z0-9_.]*)", 1)), F.lit(""))
    out = found.where(cics | sql).groupBy(key).agg(
        F.count_if(cics).alias("n_cics"), F.count_if(sql).alias("n_sql"), F.array_sort(F.collect_set(F.when(cics, command))).alias("cics_commands"), F.array_sort(F.collect_set(F.when(sql, command))).alias("sql_commands"),
        F.array_sort(F.collect_set(F.when(sql, table))).alias("tables"), F.count_if(sql & command.isin("SELECT", "FETCH")).alias("n_reads"), F.count_if(sql & command.isin("INSERT", "UPDATE", "DELETE", "MERGE")).alias("n_writes"))
    return out.withColumn("returns", F.array_contains("cics_commands", "RETURN"))


def either_side(calls: DataFrame, copies: DataFrame) -> DataFrame:
    """All that each program depends on, by calls (calling, called) and by copies (program, copybook), each once: program, dependency."""
    return calls.select(F.col("calling").alias("program"), F.col("called").alias("dependency")).union(copies.select("program", "copybook")).where("dependency is not null").distinct()


def common_kinds(rows: DataFrame, program: str, kind: str, first: Column, second: Column) -> DataFrame:
    """The kinds that programs of both sides show."""
    return rows.where(first).select(kind).intersect(rows.where(second).select(kind))


def newest(rows: DataFrame, key: str, ts: str, order: str, most: int, hours: int) -> DataFrame:
    """Of each key the last rows, at most so many and no older than so many hours before the newest row of all (a ring buffer with retention)."""
    from .reports import since

    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order)))
    return since(rows, ts, f"{hours} hours").withColumn("_n", n).where(F.col("_n") <= most).drop("_n")
