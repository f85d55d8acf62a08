"""What programs are and what they touch: relations found line by line, merged over sections, reports, kinds, metadata, lifecycles.

Edge cases: a null text has no relations, no kind and empty lists.  Names are in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mentions import mentions
from .program import tidy

#: How sure a relation is that a single line shows, by its category.
CONFIDENCE = {"cics_file": 0.7, "cics_program": 0.8, "copybook": 0.9, "call": 0.8, "sql": 0.8, "field": 0.9}
NAME = "[A-Z][A-Z0-9-]*"


def line_relations(sources: DataFrame, key: str, text: str, first_line: str | None = None) -> DataFrame:
    """What each line of a source relates it to: key, category, type, target, line, confidence.

    A line counts once, for the first of: an EXEC CICS on a file or a program, COPY, CALL of a literal, EXEC SQL, a field with
    a picture.  first_line: a column with the number of the source's first line, for sections of a program.
    """
    start = F.col(first_line) if first_line else F.lit(1)
    lines = sources.select(key, start.alias("_first"), F.posexplode(F.split(tidy(F.col(text)), "\n")).alias("_i", "_x")).withColumn("_u", F.upper(F.trim("_x")))

    def part(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract("_u", pattern, group)

    u = F.col("_u")
    file = F.coalesce(F.nullif(part(r"DATASET\s*\(\s*['\"]([^'\"]+)['\"]"), F.lit("")), F.nullif(part(r"FILE\s*\(\s*['\"]([^'\"]+)['\"]"), F.lit("")))
    program = F.nullif(part(r"PROGRAM\s*\(\s*['\"]([^'\"]+)['\"]"), F.lit(""))
    table = F.coalesce(F.nullif(part(r"FROM\s+([A-Z][A-Z0-9_]*)"), F.lit("")), F.lit("UNKNOWN_TABLE"))

    def row(category: str, kind: Column | str, target: Column) -> Column:
        return F.when(target.isNotNull() & (target != ""), F.struct(F.lit(category).alias("category"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), target.alias("target"), F.lit(CONFIDENCE[category]).alias("confidence")))

    verb = F.when(F.contains(u, F.lit("SELECT")), "SELECT").when(F.contains(u, F.lit("INSERT")), "INSERT").when(F.contains(u, F.lit("UPDATE")), "UPDATE").when(F.contains(u, F.lit("DELETE")), "DELETE").otherwise("SELECT")
    cics = F.when(F.contains(u, F.lit("DATASET(")) | F.contains(u, F.lit("FILE(")), row("cics_file", F.when(F.contains(u, F.lit("READ")), "CICS_READ").otherwise("CICS_WRITE"), file)).when(
        u.rlike("LINK|XCTL"), row("cics_program", F.when(F.contains(u, F.lit("LINK")), "CICS_LINK").otherwise("CICS_XCTL"), program))
    found = (F.when(F.contains(u, F.lit("EXEC CICS")), cics).when(u.rlike(r"(^|\s)COPY\s"), row("copybook", "COPY", part(rf"COPY\s+({NAME})"))).when(u.rlike(r"CALL\s"), row("call", "CALL", part(r"CALL\s+['\"]([^'\"]+)['\"]")))
             .when(F.contains(u, F.lit("EXEC SQL")), row("sql", F.concat(F.lit("SQL_"), verb), table)).when(u.rlike(r"^\d+\s+\w+.*PIC\s+"), row("field", "FIELD_DEFINITION", part(rf"^\d+\s+({NAME})\s+.*PIC\s+[X9V()]+"))))
    return lines.withColumn("_r", found).where("_r is not null").select(key, "_r.category", "_r.type", "_r.target", (F.col("_first") + F.col("_i")).alias("line"), "_r.confidence")


def merged_sections(relations: DataFrame, key: str) -> DataFrame:
    """Relations of all sections of a program, each once for its category, type, target and line, with its greatest confidence."""
    return relations.groupBy(key, "category", "type", "target", "line").agg(F.max("confidence").alias("confidence"))


def program_report(relations: DataFrame, key: str, books: DataFrame, programs: DataFrame) -> DataFrame:
    """A row for each program: how many relations of each category, the copybooks and programs it needs, those that are missing, and how sure that is.

    books and programs: names (column name) that there are.
    """
    # Relations are found once: those that need nothing stay beside the others, with a kind that nothing has and names that go to all tasks.
    kind = F.when(F.col("category") == "copybook", "book").when(F.col("category").isin("call", "cics_program"), "program").otherwise("")
    rows = relations.select(key, "category", "confidence", kind.alias("kind"), F.when(kind == "", F.col(key).cast("string")).otherwise(F.upper("target")).alias("name"))
    known = books.select(F.lit("book").alias("kind"), F.upper("name").alias("name")).union(programs.select(F.lit("program"), F.upper("name"))).distinct().withColumn("known", F.lit(True))
    return rows.join(known, ["kind", "name"], "left").groupBy(key).agg(*(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CONFIDENCE), F.round(F.avg("confidence"), 4).alias("confidence"), *(
        F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & (F.lit(True) if every else F.col("known").isNull()), F.col("name")))).alias(out)
        for kind, every, out in (("book", True, "required_copybooks"), ("program", True, "called_programs"), ("book", False, "missing_copybooks"), ("program", False, "missing_programs")))).withColumn("has_missing", (F.size("missing_copybooks") > 0) | (F.size("missing_programs") > 0))


#: Calls, structures and beginnings of constants of message queues.
MQ_CALLS = "MQOPEN MQPUT MQGET MQCLOSE MQCONN MQCONNX MQDISC MQBEGIN MQCMIT MQBACK MQPUT1 MQINQ MQSET MQSUB".split()
MQ_STRUCTURES = "MQMD MQOD MQPMO MQGMO MQSD MQCNO MQHCONN MQHOBJ".split()
MQ_CONSTANTS = "MQCC_ MQRC_ MQOT_ MQOO_ MQGMO_ MQPMO_".split()


def kinds(text: Column, suffix: Column | None = None) -> dict[str, Column]:
    """What a source is, each by a test of its own: stored_procedure, message_queue, bms, heavy_cics, jcl, cobol, copybook.  suffix: of its file, with the point."""
    u = F.upper(F.coalesce(text, F.lit("")))
    end = F.lower(F.coalesce(suffix, F.lit(""))) if suffix is not None else F.lit("")

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(u, F.lit(w))
        return out

    def n(*words: str) -> Column:
        return sum((F.contains(u, F.lit(w)).cast("int") for w in words), F.lit(0))

    def times(pattern: str) -> Column:
        return F.regexp_count(u, F.lit(pattern))

    sql, procedure = n("SQLCA", "EXEC SQL", "SQLCODE", "SQLSTATE"), n("EXEC SQL CALL", "RESULT SET", "ASSOCIATE LOCATOR", "ALLOCATE CURSOR")
    lines = F.length(u) - F.length(F.replace(u, F.lit("\n"), F.lit(""))) + 1
    divisions = has("IDENTIFICATION DIVISION", "PROCEDURE DIVISION")
    return {
        "stored_procedure": has("PROCEDURE DIVISION") & (has("EXEC SQL CREATE PROCEDURE") | ((sql >= 2) & (procedure >= 1))),
        "message_queue": (times(rf"CALL ['\"]?(?:{'|'.join(MQ_CALLS)})") >= 1) | has(*MQ_STRUCTURES) | (times("|".join(MQ_CONSTANTS)) >= 2),
        "bms": has("DFHMSD", "DFHMDI", "DFHMDF"),
        "heavy_cics": times("EXEC CICS") > F.greatest(F.lit(5.0), lines * 0.1),
        "jcl": (end == ".jcl") | (F.startswith(F.trim(F.coalesce(text, F.lit(""))), F.lit("//")) & has("JOB", "EXEC", "DD")),
        "cobol": has("IDENTIFICATION DIVISION", "PROGRAM-ID", "WORKING-STORAGE SECTION", "PROCEDURE DIVISION", "DATA DIVISION"),
        "copybook": end.isin(".cpy", ".copy") | (has("PIC") & has("01 ", "05 ") & ~divisions & (lines < 500)) | has("COPY", "REPLACING", "OCCURS", "REDEFINES"),
    }


#: Words that are told as operations, and as operations on files, if a text has them.
OPERATIONS = "MOVE COMPUTE PERFORM IF READ WRITE CALL ADD SUBTRACT".split()
FILE_OPERATIONS = "OPEN CLOSE READ WRITE REWRITE DELETE".split()


def metadata(text: Column) -> dict[str, Column]:
    """Lists, sorted and distinct: field_names, operations, cics_operations, db2_operations, database_tables, file_operations.  Operations are whole words."""
    u = F.upper(F.coalesce(text, F.lit("")))

    def all_(pattern: str, group: int = 1) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(u, F.lit(pattern), F.lit(group))))

    def words(names: list[str]) -> Column:
        return all_(rf"(?<![A-Z0-9-])({'|'.join(names)})(?![A-Z0-9-])")

    return {
        "field_names": all_(r"(?m)^\s*\d+\s+([A-Z0-9_-]+)"), "operations": words(OPERATIONS), "cics_operations": all_(r"EXEC\s+CICS\s+(\w+)"), "db2_operations": all_(r"EXEC\s+SQL\s+(\w+)"),
        "database_tables": all_(r"(?<![A-Z0-9-])(?:FROM|INTO|UPDATE)\s+([A-Z0-9_]+)"), "file_operations": words(FILE_OPERATIONS),
    }


#: Words that show what is done to a file or table in a piece of code, looked for in this order.
STAGES = (("creation", ("CREATE", "WRITE", "OUTPUT")), ("read", ("READ", "SELECT", "INPUT")), ("update", ("UPDATE", "REWRITE", "MODIFY")), ("delete", ("DELETE", "REMOVE", "PURGE")))
BRANCHES = ("CALL", "PERFORM", "GO TO", "IF", "EVALUATE")


def data_lifecycle(chunks: DataFrame, program: str, chunk: str, text: str, names: DataFrame) -> DataFrame:
    """For each name (column name): programs, chunks and how many of these create, read, update or delete it.

    A chunk counts for the first of STAGES whose words it has; all chunks that have the name as a whole word count.
    """
    u = F.upper(F.coalesce(text, F.lit("")))
    stage = F.lit(None).cast("string")
    for name, words in reversed(STAGES):
        stage = F.when(u.rlike("|".join(words)), name).otherwise(stage)
    found = mentions(chunks, chunk, text, names, "name").select("name", chunk).join(chunks.select(chunk, F.col(program).alias("_p"), stage.alias("_s")), chunk)
    return found.groupBy("name").agg(F.count_distinct("_p").alias("programs"), F.count("*").alias("chunks"), *(F.count_if(F.col("_s") == s).alias(f"n_{s}") for s, _ in STAGES))


def structure_lifecycle(chunks: DataFrame, program: str, kind: str, text: str) -> DataFrame:
    """For each program or job: its chunks by kind (as kind=number, sorted), how many branch, how many are steps, and whether it runs programs and defines data."""
    u = F.upper(F.coalesce(text, F.lit("")))
    rows = chunks.select(F.col(program).alias("program"), F.coalesce(kind, F.lit("")).alias("kind"), u.rlike("|".join(BRANCHES)).alias("b"), F.contains(u, F.lit("EXEC")).alias("e"), F.contains(u, F.lit("DD")).alias("d"))
    by_kind = rows.groupBy("program", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("b")).alias("b"), F.max("e").alias("e"), F.max("d").alias("d"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",")
    return by_kind.groupBy("program").agg(F.sum("n").alias("chunks"), listed.alias("kinds"), F.sum("b").alias("branching"), F.coalesce(F.sum(F.when(F.col("kind") == "job_step", F.col("n"))), F.lit(0)).alias("steps"), F.max("e").alias("executes"), F.max("d").alias("defines_data"))


def procedure_calls(statements: DataFrame, key: str) -> DataFrame:
    """Embedded calls of procedures and their result sets, from program.statements: key, line, kind (call, locators, cursor), name, parameters."""
    b = F.col("body")
    call, locators, cursor = r"(?i)^SQL\s+CALL\s+([A-Z][A-Z0-9_.]*)\s*(?:\((.*)\))?", r"(?i)^SQL\s+ASSOCIATE\s+(?:RESULT\s+SET\s+)?LOCATORS?\s*\((.*?)\)(?:\s+WITH\s+PROCEDURE\s+([A-Z][A-Z0-9_.]*))?", r"(?i)^SQL\s+ALLOCATE\s+([A-Z][A-Z0-9_-]*)\s+CURSOR\s+FOR\s+RESULT\s+SET\s+:?([A-Z][A-Z0-9_-]*)"

    def get(pattern: str, group: int) -> Column:
        return F.regexp_extract(b, pattern, group)

    def listed(x: Column) -> Column:
        return F.filter(F.transform(F.split(x, ","), lambda p: F.trim(F.regexp_replace(p, "^\\s*:", ""))), lambda p: p != "")

    kind = F.when(b.rlike(call), "call").when(b.rlike(locators), "locators").when(b.rlike(cursor), "cursor")
    name = F.when(b.rlike(call), get(call, 1)).when(b.rlike(locators), F.nullif(get(locators, 2), F.lit(""))).otherwise(get(cursor, 1))
    parameters = F.when(b.rlike(call), listed(get(call, 2))).when(b.rlike(locators), listed(get(locators, 1))).otherwise(listed(get(cursor, 2)))
    return statements.where("verb = 'EXEC'").select(key, "line", kind.alias("kind"), F.upper(name).alias("name"), F.transform(parameters, F.upper).alias("parameters")).where("kind is not null")
