"""Facts from sources: one rule engine for all languages.

A rule names a kind of fact, a regular expression with up to three groups, and
whether it is tried on every line or on the whole text (for statements that
run over several lines).  All rules of a language are applied in one pass as
column expressions, so there is no Python in the hot path and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .copybooks import counted
from .program import tidy

NAME = "([A-Za-z0-9][A-Za-z0-9_#@$-]*)"
QNAME = "['\"]?" + NAME + "['\"]?"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    whole: bool = False
    groups: int = 1
    word: str = ""  # a cheap test that the text must pass first: words in upper case, one of which it holds (with bars between)


#: COBOL.  Lines with a star in column 7 or at their head are comments.
COBOL = (
    Rule("division", r"(?i)^\s*(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION", word="DIVISION"),
    Rule("section", r"(?i)^\s*([A-Z0-9][A-Z0-9-]*)\s+SECTION\s*\.", word="SECTION"),
    Rule("program_id", r"(?i)^\s*PROGRAM-ID\s*\.\s*" + NAME, word="PROGRAM-ID"),
    Rule("paragraph", r"(?i)^(?:\s{7}|\s{0,7})(?!END-|EXIT|STOP|GOBACK|CONTINUE|ELSE)([A-Z0-9][A-Z0-9-]*)\s*\.\s*$", word="."),
    Rule("data_item", r"(?i)^\s*([0-9]{2})\s+" + NAME + r"(?:\s+(.*?))?\s*\.?\s*$", groups=3),
    Rule("select", r"(?i)^\s*SELECT\s+(?:OPTIONAL\s+)?" + NAME + r"\s+ASSIGN\s+(?:TO\s+)?" + QNAME, groups=2, word="SELECT"),
    Rule("fd", r"(?i)^\s*FD\s+" + NAME, word="FD"),
    Rule("open", r"(?i)\bOPEN\s+(INPUT|OUTPUT|I-O|EXTEND)\s+" + NAME, groups=2, word="OPEN"),
    Rule("file_op", r"(?i)(?<![A-Z0-9-])(READ|WRITE|REWRITE|DELETE|CLOSE|START)\s+" + NAME, groups=2, word="READ|WRITE|DELETE|CLOSE|START"),
    Rule("call", r"(?i)(?<![A-Z0-9-])(CALL)\s+['\"]" + NAME + r"['\"](?:\s+USING\s+([A-Z0-9 ,-]+?))?\s*\.?\s*$", groups=3, word="CALL"),
    Rule("dynamic_call", r"(?i)(?<![A-Z0-9-])(CALL)\s+([A-Z][A-Z0-9-]*)", groups=2, word="CALL"),
    Rule("perform", r"(?i)(?<![A-Z0-9-])PERFORM\s+(?!UNTIL|VARYING|[0-9]+\s+TIMES)" + NAME + r"(?:\s+(?:THRU|THROUGH)\s+" + NAME + r")?(?:\s+(UNTIL|VARYING|TIMES)\b)?", groups=3, word="PERFORM"),
    Rule("perform_inline", r"(?i)(?<![A-Z0-9-])PERFORM\s+(UNTIL|VARYING|[0-9]+\s+TIMES)", word="PERFORM"),
    Rule("decision", r"(?i)(?<![A-Z0-9-])(IF|EVALUATE|WHEN)\s+(.*?)\s*\.?\s*$", groups=2, word="IF|EVALUATE|WHEN"),
    Rule("error_handling", r"(?i)(?<![A-Z0-9-])(NOT\s+ON\s+EXCEPTION|ON\s+EXCEPTION|ON\s+ERROR|INVALID\s+KEY|AT\s+END)(?![A-Z0-9-])", word="EXCEPTION|ERROR|INVALID|END"),
    Rule("end_decision", r"(?i)(?<![A-Z0-9-])END-(IF|EVALUATE)", word="END-"),
    Rule("goto", r"(?i)(?<![A-Z0-9-])GO\s+TO\s+" + NAME, word="GO"),
    Rule("move", r"(?i)(?<![A-Z0-9-])MOVE\s+(\S+)\s+TO\s+" + NAME, groups=2, word="MOVE"),
    Rule("compute", r"(?i)(?<![A-Z0-9-])COMPUTE\s+" + NAME + r"(?:\s+ROUNDED)?\s*=\s*(.*?)\s*\.?\s*$", groups=2, word="COMPUTE"),
    Rule("arithmetic", r"(?i)(?<![A-Z0-9-])(ADD|SUBTRACT|MULTIPLY|DIVIDE)\s+(\S+)\s+(?:TO|FROM|BY|INTO)\s+" + NAME, groups=3, word="ADD|SUBTRACT|MULTIPLY|DIVIDE"),
    Rule("copy", r"(?i)^\s*COPY\s+" + QNAME + r"(?:\s+REPLACING\s+(.*?))?\s*\.?\s*$", groups=2, word="COPY"),
    Rule("sql", r"(?is)EXEC\s+SQL\s+([A-Z]+)\b(.*?)END-EXEC", whole=True, groups=2, word="EXEC"),
    Rule("cics", r"(?is)EXEC\s+CICS\s+([A-Z]+)\b(.*?)END-EXEC", whole=True, groups=2, word="EXEC"),
    Rule("transaction", r"(?i)(?<![A-Z0-9-])(COMMIT|ROLLBACK|SYNCPOINT)\b", word="COMMIT|ROLLBACK|SYNCPOINT"),
)
JCL = (
    Rule("job", r"^//([A-Z0-9#@$]+)\s+JOB\b", word="JOB"),
    Rule("step", r"^//([A-Z0-9#@$]+)\s+EXEC\s+(?:PGM=([A-Z0-9#@$]+)|(?:PROC=)?([A-Z0-9#@$]+))", groups=3, word="EXEC"),
    Rule("dd", r"^//([A-Z0-9#@$.]+)\s+DD\s+(.*)$", groups=2, word="DD"),
    Rule("proc", r"^//([A-Z0-9#@$]+)\s+PROC\b", word="PROC"),
    Rule("control", r"^//(?:[A-Z0-9#@$]*)\s+(IF|ELSE|ENDIF)\b\s*(.*)$", groups=2, word="IF|ELSE|ENDIF"),
    Rule("cond", r"COND=(\([^)]*\)|[A-Z]+)", word="COND="),
)
BMS = (
    Rule("mapset", r"^\s*([A-Z0-9#@$]+)\s+DFHMSD\b\s*(.*)$", groups=2, word="DFHMSD"),
    Rule("map", r"^\s*([A-Z0-9#@$]+)\s+DFHMDI\b\s*(.*)$", groups=2, word="DFHMDI"),
    Rule("field", r"^\s*([A-Z0-9#@$]+)\s+DFHMDF\b\s*(.*)$", groups=2, word="DFHMDF"),
)
MQ = (
    Rule("mq_call", r"(?i)\b(MQCONN|MQDISC|MQOPEN|MQCLOSE|MQPUT1|MQPUT|MQGET|MQINQ|MQSET|MQBEGIN|MQCMIT|MQBACK|MQSUB)\b", word="MQ"),
    Rule("mq_structure", r"(?i)\b(MQMD|MQOD|MQGMO|MQPMO|MQSD)\b", word="MQ"),
    Rule("mq_error", r"(?i)\b(MQRC[_-][A-Z0-9_-]+|MQCC[_-][A-Z]+)", word="MQ"),
)
DB2 = (
    Rule("procedure", r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+([A-Z0-9_.]+)\s*(.*?)(?=\bBEGIN\b|$)", whole=True, groups=2, word="PROCEDURE"),
    Rule("declare", r"(?i)^\s*DECLARE\s+(?!CONTINUE\b|EXIT\b|UNDO\b)([A-Z0-9_]+)\s+((?!CURSOR|CONTINUE|EXIT|UNDO)[A-Z]+(?:\([0-9, ]+\))?)", groups=2, word="DECLARE"),
    Rule("cursor", r"(?is)DECLARE\s+([A-Z0-9_]+)\s+CURSOR\b.*?\bFOR\s+(.*?);", whole=True, groups=2, word="CURSOR"),
    Rule("handler", r"(?i)DECLARE\s+(CONTINUE|EXIT|UNDO)\s+HANDLER\s+FOR\s+([A-Z0-9_' ]+)", groups=2, word="HANDLER"),
    Rule("db2_control", r"(?i)^\s*(IF|CASE|WHILE|FOR|REPEAT|LOOP)\b", word="IF|CASE|WHILE|FOR|REPEAT|LOOP"),
    Rule("dynamic_sql", r"(?i)\b(PREPARE|EXECUTE\s+IMMEDIATE|EXECUTE)\s+([A-Z0-9_]+)", groups=2, word="PREPARE|EXECUTE"),
    Rule("statement", r"(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|FETCH|OPEN|CLOSE)\b", word="SELECT|INSERT|UPDATE|DELETE|MERGE|FETCH|OPEN|CLOSE"),
    Rule("whenever", r"(?i)WHENEVER\s+(SQLERROR|SQLWARNING|NOT\s+FOUND)\s+(.*?)(?:\s*END-EXEC.*)?$", groups=2, word="WHENEVER"),
    Rule("sqlca", r"(?i)\b(SQLCA|SQLDA|SQLCODE|SQLSTATE)\b", word="SQL"),
    Rule("host_variable", r":([A-Z][A-Z0-9_-]*)", word=":"),
)
LANGUAGES = {"cobol": COBOL, "jcl": JCL, "bms": BMS, "mq": MQ, "db2": DB2}


def only(rules: tuple[Rule, ...], *kinds: str) -> tuple[Rule, ...]:
    """The rules of some kinds; facts that nobody asks for are not looked for."""
    if unknown := set(kinds) - {r.kind for r in rules}:
        raise ValueError(f"no such rules: {', '.join(sorted(unknown))}")
    return tuple(r for r in rules if r.kind in kinds)


def facts(sources: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each match: key, line (from 1; of the match's first line for whole-text rules), kind, a, b, c (empty groups are null)."""
    def row(rule: Rule, line: Column, found: Column) -> Column:
        parts = [F.regexp_extract(found, rule.pattern, g) if g <= rule.groups else F.lit(None).cast("string") for g in (1, 2, 3)]
        return F.struct(line.cast("int").alias("line"), F.lit(rule.kind).alias("kind"), *[p.alias(n) for p, n in zip(parts, "abc", strict=True)])

    def matches(rule: Rule, line: Column, body: Column, upper: Column) -> Column:
        found = F.transform(F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0)), lambda m: row(rule, line, m))
        if not rule.word:
            return found
        holds = F.lit(False)
        for word in rule.word.split("|"):
            holds = holds | F.contains(upper, F.lit(word))
        return F.when(holds, found).otherwise(F.array().cast(kind_of))

    kind_of = "array<struct<line:int,kind:string,a:string,b:string,c:string>>"
    lines = [r for r in rules if not r.whole]
    whole = [r for r in rules if r.whole]
    comment = r"^(\s*\*|.{6}\*|//\*)"
    source = tidy(F.col(text)) if set(rules) & set(COBOL) else F.coalesce(F.col(text), F.lit(""))
    out = None
    if lines:
        each = sources.select(key, F.posexplode(F.split(source, "\n")).alias("_i", "_l")).select(key, (F.col("_i") + 1).alias("_i"), F.rtrim("_l").alias("_x"), F.upper("_l").alias("_u")).where(~F.col("_x").rlike(comment))
        by_line = each.select(key, F.explode(F.flatten(F.array(*[matches(r, F.col("_i"), F.col("_x"), F.col("_u")) for r in lines]))).alias("f"))
        out = by_line.select(key, "f.*")
    if whole:
        def ends(x: Column) -> Column:
            return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

        def found_by(rule: Rule) -> Column:
            """Between the matches stand the parts of the split text, so a match's line is known from the lines of what stands before it."""
            hits = F.regexp_extract_all("_t", F.lit(rule.pattern), F.lit(0))
            parts = counted(F.transform(F.split("_t", rule.pattern), ends))
            above = F.concat(F.array(F.lit(0)), counted(F.transform(hits, ends)))
            each = F.filter(F.arrays_zip(hits.alias("m"), parts.alias("p"), above.alias("h")), lambda z: z["m"].isNotNull())
            return F.transform(each, lambda z: row(rule, z["p"] + z["h"] + 1, z["m"]))

        bare = F.regexp_replace(source, r"(?md)^(?:[^\S\n]*\*|[^\n\r\u0085\u2028\u2029]{6}\*|//\*)[^\n]*", "")
        found = [found_by(r) for r in whole]
        by_text = sources.select(key, bare.alias("_t")).select(key, F.explode(F.flatten(F.array(*found))).alias("f")).select(key, "f.*")
        out = by_text if out is None else out.unionByName(by_text)
    return out.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in "abc"})


#: The facts that edges and the like are made of.
CALL_KINDS = ("call", "dynamic_call", "cics", "decision", "end_decision")
FILE_KINDS = ("select", "fd", "open", "file_op")
FIELD_KINDS = ("move", "compute", "arithmetic", "decision")
REACH_KINDS = ("division", "paragraph", "perform", "goto")
LOGIC_KINDS = ("decision", "move", "compute", "perform", "perform_inline", "call", "dynamic_call", "open", "file_op", "arithmetic", "error_handling")


def calls(found: DataFrame, key: str) -> DataFrame:
    """Call edges of COBOL, CICS and JCL facts: calling, called, call_type, line, parameters, conditional (see ``conditional``)."""
    target = F.when(F.col("kind").isin("call", "dynamic_call"), F.col("b")).when(F.col("kind") == "step", F.coalesce("b", "c")).when(
        (F.col("kind") == "cics") & F.col("a").isin("LINK", "XCTL"), F.nullif(F.regexp_extract("b", r"(?i)PROGRAM\s*\(\s*['\"]?([A-Z0-9#@$-]+)", 1), F.lit("")))
    kind = F.when(F.col("kind") == "call", "COBOL_CALL").when(F.col("kind") == "dynamic_call", "COBOL_DYNAMIC_CALL").when(F.col("kind") == "cics", F.concat(F.lit("CICS_"), F.col("a"))).when(F.col("b").isNotNull(), "JCL_EXEC_PGM").otherwise("JCL_EXEC_PROC")
    parameters = F.when(F.col("kind") == "call", F.array_remove(F.split(F.coalesce("c", F.lit("")), "[ ,]+"), ""))
    rows = conditional(found, key).where(F.col("kind").isin("call", "dynamic_call", "step", "cics"))
    return rows.select(F.col(key).alias("calling"), target.alias("called"), kind.alias("call_type"), "line", parameters.alias("parameters"), "conditional").where("called is not null")


def conditional(found: DataFrame, key: str) -> DataFrame:
    """Adds whether a fact stands below an IF or EVALUATE (with a WHEN) that has not ended yet."""
    before = Window.partitionBy(key).orderBy("line").rangeBetween(Window.unboundedPreceding, -1)

    def n(kind: str, word: str) -> Column:
        return F.coalesce(F.count_if((F.col("kind") == kind) & (F.upper("a") == word)).over(before), F.lit(0))

    open_if = n("decision", "IF") > n("end_decision", "IF")
    open_case = (n("decision", "EVALUATE") > n("end_decision", "EVALUATE")) & (n("decision", "WHEN") > 0)
    return found.withColumn("conditional", open_if | open_case)


def copies(found: DataFrame, key: str) -> DataFrame:
    """Copybook edges."""
    return found.where("kind = 'copy'").select(F.col(key).alias("program"), F.col("a").alias("copybook"), F.col("b").alias("replacing"), "line")


def file_access(found: DataFrame, key: str) -> DataFrame:
    """File edges: program, file, physical, access_type, access_mode, line.  The mode of an operation is that of the latest OPEN of the file, if any."""
    rows = found.where(F.col("kind").isin("select", "fd", "open", "file_op"))
    is_open, is_select = F.col("kind") == "open", F.col("kind") == "select"
    file = F.when(F.col("kind").isin("select", "fd"), F.col("a")).otherwise(F.col("b"))
    access = F.when(is_select, "SELECT").when(F.col("kind") == "fd", "FD").when(is_open, "OPEN").otherwise(F.upper("a"))
    rows = rows.select(F.col(key).alias("program"), F.upper(file).alias("file"), F.when(is_select, F.col("b")).alias("physical"), access.alias("access_type"), F.when(is_open, F.upper("a")).alias("_mode"), "line")
    latest = F.last("_mode", ignorenulls=True).over(Window.partitionBy("program", "file").orderBy("line"))
    return rows.select("program", "file", "physical", "access_type", F.when(~F.col("access_type").isin("SELECT", "FD"), latest).alias("access_mode"), "line")


def field_usage(found: DataFrame, key: str) -> DataFrame:
    """READ, WRITE, TRANSFORM and VALIDATE uses of fields, each with its line."""
    uses = (F.when(F.col("kind") == "move", F.array(F.struct(F.col("a").alias("field"), F.lit("READ").alias("use")), F.struct(F.col("b").alias("field"), F.lit("WRITE").alias("use"))))
            .when(F.col("kind") == "compute", F.array(F.struct(F.col("a").alias("field"), F.lit("TRANSFORM").alias("use"))))
            .when(F.col("kind") == "arithmetic", F.array(F.struct(F.col("c").alias("field"), F.lit("TRANSFORM").alias("use"))))
            .when((F.col("kind") == "decision") & (F.upper("a") == "IF"), F.array(F.struct(F.regexp_extract("b", r"^(?:NOT\s+)?([A-Za-z][A-Za-z0-9-]*)", 1).alias("field"), F.lit("VALIDATE").alias("use")))))
    return found.select(F.col(key).alias("program"), "line", F.explode(uses).alias("u")).select("program", "line", F.upper("u.field").alias("field"), "u.use").where(F.col("field").rlike("^[A-Z][A-Z0-9-]*$"))


def data_items(found: DataFrame, key: str, parent: bool = True) -> DataFrame:
    """Fields of a layout: level, name, picture, type, occurs, redefines, usage and, if asked for, the parent group."""
    from ..functions import names as N
    from .ordered import parents

    items = found.where("kind = 'data_item'").select(key, "line", F.col("a").cast("int").alias("level"), F.upper("b").alias("name"), F.upper(F.coalesce("c", F.lit(""))).alias("rest"))
    pic = F.nullif(F.regexp_extract("rest", r"PIC(?:TURE)?\s+(?:IS\s+)?(\S+?)\.?(?:\s|$)", 1), F.lit(""))
    out = items.withColumns({
        "picture": pic, "redefines": F.nullif(F.regexp_extract("rest", r"REDEFINES\s+([A-Z0-9-]+)", 1), F.lit("")), "occurs": F.when(F.contains(F.col("rest"), F.lit("OCCURS")), N.occurs(F.col("rest"))),
        "usage": F.nullif(F.regexp_extract("rest", r"(COMP(?:-[1-5])?|BINARY|PACKED-DECIMAL|DISPLAY|INDEX)\b", 1), F.lit(""))})
    out = out.withColumn("_symbols", N.pic_symbols(F.col("picture"))).withColumn("sql_type", F.when(F.col("picture").isNotNull(), N.pic_type(F.col("picture"), F.col("_symbols")))).drop("rest", "_symbols")
    return parents(out, [key], "line", "level", "name", F.col("level").isin(66, 88)) if parent else out


def dd_operation(rest: Column) -> Column:
    """What a DD statement does to its data set, from DISP with or without parentheses."""
    disp = F.regexp_extract(F.upper(rest), r"DISP=\(?([A-Z]+)", 1)
    return F.when(disp == "NEW", "CREATE").when(disp.isin("OLD", "SHR"), "READ").when(disp == "MOD", "UPDATE").when(disp == "", "READ").otherwise("ACCESS")


def datasets(found: DataFrame, key: str) -> DataFrame:
    """DD statements with their data set, disposition's operation and step."""
    step = F.last(F.when(F.col("kind") == "step", F.col("a")), ignorenulls=True).over(Window.partitionBy(key).orderBy("line"))
    rows = found.withColumn("step", step).where("kind = 'dd'")
    return rows.select(key, "step", F.col("a").alias("dd"), F.nullif(F.regexp_extract("b", r"DSN=([A-Z0-9.#@$()+-]+)", 1), F.lit("")).alias("dataset"), dd_operation(F.col("b")).alias("operation"), "line")


def violations(sources: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """Rules of form that a source breaks: key, rule."""
    u = F.upper(F.coalesce(F.col(text), F.lit("")))

    def lacks(word: str) -> Column:
        return ~F.contains(u, F.lit(word))

    def at(word: str) -> Column:
        return F.instr(u, word)

    order = ("IDENTIFICATION DIVISION", "ENVIRONMENT DIVISION", "DATA DIVISION", "PROCEDURE DIVISION")
    rules = {
        "cobol": [("missing_identification", lacks(order[0])), ("missing_procedure", lacks(order[3])), ("missing_program_id", lacks("PROGRAM-ID")),
                  ("division_order", ((at(order[0]) > at(order[3])) & (at(order[3]) > 0)) | ((at(order[2]) > at(order[3])) & (at(order[3]) > 0)) | ((at(order[1]) > at(order[2])) & (at(order[2]) > 0))),
                  ("invalid_level", u.rlike(r"(?m)^\s*(00|5[0-9]|6[0-57-9]|7[0-689]|8[0-79]|9[0-9])\s+[A-Z0-9-]+\s+PIC"))],
        "jcl": [("missing_job", ~u.rlike(r"(?m)^//[A-Z0-9#@$]+\s+JOB\b")), ("missing_exec", ~u.rlike(r"(?m)^//[A-Z0-9#@$]*\s+EXEC\b"))],
        "cics": [("missing_cics", lacks("EXEC CICS")), ("missing_return", ~u.rlike(r"EXEC\s+CICS\s+RETURN"))],
        "bms": [("missing_mapset", lacks("DFHMSD")), ("missing_map", lacks("DFHMDI"))],
    }[language]
    return sources.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("rule"))


def unreachable(found: DataFrame, key: str) -> DataFrame:
    """Paragraphs that no PERFORM or GO TO names; the first of a program is entered from the top."""
    inside = F.max(((F.col("kind") == "division") & (F.upper("a") == "PROCEDURE")).cast("int")).over(Window.partitionBy(key).orderBy("line").rangeBetween(Window.unboundedPreceding, 0))
    paragraphs = found.withColumn("inside", inside).where("kind = 'paragraph' and inside = 1").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("line")))
    named = found.where(F.col("kind").isin("perform", "goto")).select(key, F.explode(F.array_compact(F.array("a", F.when(F.col("kind") == "perform", F.col("b"))))).alias("a"))
    return paragraphs.where("n > 1").join(named.distinct(), [key, "a"], "left_anti").select(key, F.col("a").alias("paragraph"), "line")


def message_flow(found: DataFrame, key: str) -> DataFrame:
    """The message pattern of each program, from the calls that it makes."""
    calls_ = found.where("kind = 'mq_call'").groupBy(key).agg(F.collect_set(F.upper("a")).alias("c"))

    def has(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.array_contains("c", n)
        return out

    flow = F.when(has("MQSUB", "MQGET"), "publish_subscribe").when(has("MQBEGIN", "MQPUT", "MQCMIT"), "transactional").when(has("MQPUT", "MQGET"), "request_reply").when(has("MQPUT1"), "fire_and_forget").when(has("MQOPEN", "MQPUT", "MQCLOSE"), "persistent").otherwise("other")
    return calls_.select(key, flow.alias("flow"), F.array_sort("c").alias("calls"))


#: The words of main operations, and the tests of a layout's kind with the points of each in its complexity.
OPERATIONS = ("READ", "WRITE", "COMPUTE", "MOVE", "PERFORM", "CALL", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "OPEN", "CLOSE")
LAYOUT_POINTS = {"layout_indicators": 3, "record_types": 2, "redefines_count": 2, "occurs_count": 1, "conditional_fields": 2}


def logic(found: DataFrame, key: str) -> DataFrame:
    """What a program does: its operations, decision points, transformations and error handling, each in order of first lines.

    A program without a fact of any of these kinds has no row.
    """
    def said(*parts: Column) -> Column:
        return F.concat_ws(" ", *parts)

    kind, a, b = F.col("kind"), F.upper("a"), F.col("b")
    operation = F.when(kind.isin("move", "compute", "perform", "call", "open"), F.upper("kind")).when(kind == "perform_inline", "PERFORM").when(kind == "dynamic_call", "CALL").when(kind.isin("file_op", "arithmetic"), a)
    what = F.array(
        F.struct(F.lit("operation").alias("what"), F.when(operation.isin(*OPERATIONS), operation).alias("item")),
        F.struct(F.lit("decision").alias("what"), F.when((kind == "decision") & a.isin("IF", "WHEN"), said(a, b)).alias("item")),
        F.struct(F.lit("transformation").alias("what"), F.when(kind == "move", said(F.lit("MOVE"), F.col("a"), F.lit("TO"), b)).when(kind == "compute", said(F.lit("COMPUTE"), F.col("a"), F.lit("="), b)).alias("item")),
        F.struct(F.lit("error_handling").alias("what"), F.when(kind == "error_handling", F.regexp_replace(a, r"\s+", " ")).alias("item")))
    items = found.select(key, "line", F.explode(what).alias("w")).select(key, "line", "w.*").where("item is not null").groupBy(key, "what", "item").agg(F.min("line").alias("line"))

    def listed(name: str) -> Column:
        of = F.array_sort(F.collect_list(F.when(F.col("what") == name, F.struct("line", "item"))))
        return F.transform(of, lambda x: x["item"])

    return items.groupBy(key).agg(*[listed(n).alias(c) for n, c in (("operation", "operations"), ("decision", "decisions"), ("transformation", "transformations"), ("error_handling", "error_handling"))])


def layout_kind(text: Column) -> Column:
    """kind, complexity (20 at most) and the counts of a copybook's layout."""
    u = F.upper(F.coalesce(text, F.lit("")))
    counts = {
        "layout_indicators": F.regexp_count(u, F.lit(r"(?m)^\s*01\s+[A-Z0-9-]+")), "record_types": F.regexp_count(u, F.lit(r"(?m)^\s*[0-9]{2}\s+[A-Z0-9-]*(?:REC(?:ORD)?-TYPE|TYPE-CODE)\b")),
        "redefines_count": F.regexp_count(u, F.lit(r"\sREDEFINES\s")), "occurs_count": F.regexp_count(u, F.lit(r"\sOCCURS\s")), "conditional_fields": F.regexp_count(u, F.lit(r"\sDEPENDING\s+ON\s"))}
    kind = (F.when((counts["layout_indicators"] > 1) | (counts["record_types"] > 1), "multi_record").when(counts["conditional_fields"] > 0, "conditional_layout")
            .when(counts["redefines_count"] > 2, "redefines_layout").when(counts["occurs_count"] > 1, "occurs_layout").otherwise("single_record"))
    points = sum((counts[c] * n for c, n in LAYOUT_POINTS.items()), F.lit(0))
    return F.struct(kind.alias("kind"), F.least(points, F.lit(20)).alias("complexity"), *[c.alias(n) for n, c in counts.items()])


def records(items: DataFrame, key: str) -> DataFrame:
    """The records of layouts: each level 01 with its fields up to the next; fillers are numbered, FILLER-1 first."""
    w = Window.partitionBy(key).orderBy("line")
    rows = items.withColumn("record", F.last(F.when(F.col("level") == 1, F.col("name")), ignorenulls=True).over(w))
    filler = F.sum((F.col("name") == "FILLER").cast("int")).over(Window.partitionBy(key, "record").orderBy("line"))
    return rows.where("level not in (1, 66, 88)").withColumn("field", F.when(F.col("name") == "FILLER", F.concat(F.lit("FILLER-"), filler)).otherwise(F.col("name")))


def simple_fields(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Fields of a layout by level and name alone, when no picture can be read: every line that begins with both, but levels 01."""
    lines = sources.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "x")).where(~F.col("x").rlike(r"^\s*\*"))
    rows = lines.select(key, (F.col("at") + 1).alias("line"), F.regexp_extract("x", r"(?i)^\s*([0-9]+)\s+[A-Z][A-Z0-9-]+", 1).alias("level"), F.regexp_extract("x", r"(?i)^\s*[0-9]+\s+([A-Z][A-Z0-9-]+)", 1).alias("name"))
    return rows.where("level <> ''").withColumn("level", F.col("level").cast("int")).where("level <> 1").withColumn("sql_type", F.lit("VARCHAR(50)"))


def level_violations(items: DataFrame, key: str) -> DataFrame:
    """Levels outside 1 to 49, 66, 77 and 88, and condition names (88) that follow no item: key, line, name, rule."""
    before = F.lag("level").over(Window.partitionBy(key).orderBy("line"))
    rule = F.when(~(F.col("level").between(1, 49) | F.col("level").isin(66, 77, 88)), "INVALID_LEVEL_NUMBER").when((F.col("level") == 88) & F.col("_before").isNull(), "ORPHANED_CONDITION_NAME")
    return items.withColumn("_before", before).select(key, "line", "name", rule.alias("rule")).where("rule is not null")


#: Where structured chunks may begin, by language: pattern and name.
BOUNDARIES = {
    "cobol": ((r"(?i)^\s*([A-Z]+)\s+DIVISION", "division"), (r"(?i)^\s*[A-Z][A-Z0-9-]*\s+SECTION", "section")),
    "sql": ((r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE", "create_procedure"), (r"(?i)\bBEGIN\b", "begin_block"), (r"(?i)DECLARE\s+\w+\s+CURSOR", "cursor_declare"), (r"(?i)DECLARE\s+\w+\s+HANDLER", "handler_declare"),
            (r"(?i)\bIF\s+.*?\s+THEN", "if_statement"), (r"(?i)\bWHILE\s+.*?\s+DO\b", "while_loop"), (r"(?i)\bFOR\s+.*?\s+DO\b", "for_loop")),
    "jcl": ((r"(?i)^//\w+\s+JOB\s", "job_card"), (r"(?i)^//\w+\s+EXEC\s", "exec_step"), (r"(?i)^//\w+\s+DD\s", "dd_statement"), (r"(?i)^//\s+IF\s", "if_statement"), (r"(?i)^//\s+ENDIF", "endif_statement")),
}


def structured_chunks(sources: DataFrame, key: str, text: str, language: str, most_tokens: int = 1500) -> DataFrame:
    """Chunks of whole parts, a part being the lines from one boundary of the language to the next.

    Parts follow each other in a chunk until the next one would lift it over most_tokens estimated tokens; a longer part
    is a chunk of its own.  key, chunk, first_line, n_lines, starts_with (the first part's boundary), text.
    """
    from ..functions.scoring import estimated_tokens
    from .chunks import packed

    kind = None
    for pattern, name in BOUNDARIES[language]:
        hit = F.col("x").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    lines = sources.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "x")).withColumn("kind", kind)
    part = F.count("kind").over(Window.partitionBy(key).orderBy("at"))
    parts = lines.withColumn("part", part).groupBy(key, "part").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]), "\n").alias("x"), F.count("*").alias("n"), F.min_by("kind", "at").alias("kind"))
    return packed(parts.withColumn("size", estimated_tokens(F.col("x"))), key, most_tokens)


def source_kind(text: Column, name: Column | None = None) -> Column:
    """What a source is, by the first test that holds: stored procedure, MQ, COBOL with SQL procedures, BMS, CICS, JCL, COBOL, copybook, ending, unknown."""
    u = F.upper(F.coalesce(text, F.lit("")))
    lines = F.size(F.split(u, "\n"))
    cics = F.regexp_count(u, F.lit(r"EXEC\s+CICS"))
    out = (
        F.when(u.rlike(r"CREATE\s+(OR\s+REPLACE\s+)?PROCEDURE"), "db2_procedure")
        .when(u.rlike(r"CALL\s+['\"]?MQ(CONN|OPEN|PUT|GET|CLOSE)"), "mq_program")
        .when((F.regexp_count(u, F.lit(r"EXEC\s+SQL")) >= 2) & u.rlike("LINKAGE SECTION") & u.rlike("RESULT SET|SQLCA"), "cobol_stored_procedure")
        .when(u.rlike("DFHMSD|DFHMDI|DFHMDF"), "bms").when(cics > F.greatest(F.lit(5), F.floor(lines / 10)), "cics")
        .when(u.rlike(r"(?m)^//[A-Z0-9#@$]+\s+(JOB|EXEC|PROC)\b"), "jcl").when(u.rlike("IDENTIFICATION DIVISION|PROCEDURE DIVISION|PROGRAM-ID"), "cobol")
        .when(u.rlike(r"(?m)^\s*[0-9]{2}\s+[A-Z0-9-]+.*PIC") & (lines < 500), "copybook")
    )
    if name is not None:
        for ending, kind in ((".cbl", "cobol"), (".cob", "cobol"), (".jcl", "jcl"), (".cpy", "copybook"), (".bms", "bms"), (".sql", "db2_procedure")):
            out = out.when(F.lower(name).endswith(ending), kind)
    return out.otherwise("unknown")


def content_kind(text: Column) -> Column:
    """DDL, DCLGEN, copybook, CSV or unknown."""
    u = F.upper(F.coalesce(text, F.lit("")))
    return (F.when(u.rlike(r"CREATE\s+TABLE"), "ddl").when(u.rlike("DECLARE") & u.rlike("TABLE"), "dclgen").when(u.rlike(r"(?m)^\s*[0-9]{2}\s+[A-Z0-9-]+\s+PIC"), "copybook")
            .when(F.contains(u, F.lit(",")) & F.contains(u, F.lit("\n")), "csv").otherwise("unknown"))


def delimiter(text: Column) -> Column:
    """Of comma, bar, tab, semicolon and colon the one most frequent in the first five lines whose counts take two values at most; comma without any."""
    head = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 5)
    marks = (",", "|", "\t", ";", ":")

    def total(mark: str) -> Column:
        counts = F.transform(head, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
        return F.when(F.size(F.array_distinct(counts)) <= 2, F.aggregate(counts, F.lit(0), lambda a, c: a + c)).otherwise(0)

    totals = [total(m) for m in marks]
    most = F.greatest(*totals)
    out = F.when(most == 0, ",")
    for m, n in zip(marks, totals, strict=True):
        out = out.when(n == most, m)
    return out


def ddl_columns(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Columns of CREATE TABLE and DECLARE TABLE statements; commas and parentheses of types are kept together."""
    body = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(r"(?i)(?:CREATE TABLE|DECLARE) ([A-Z0-9_.\"]+) (?:TABLE )?\(((?:[^()]|\([^()]*\))*)\)"), F.lit(0))
    head = r"(?i)(?:CREATE TABLE|DECLARE) ([A-Z0-9_.\"]+) (?:TABLE )?\("
    stmt = sources.select(key, F.explode(body).alias("s")).select(key, F.regexp_extract("s", head, 1).alias("table"), F.regexp_replace(F.regexp_replace("s", head, ""), r"\)$", "").alias("cols"))
    parts = F.split(F.regexp_replace("cols", r",(?![^()]*\))", "\u0001"), "\u0001")
    rows = stmt.select(key, "table", F.posexplode(parts).alias("at", "c")).select(key, "table", "at", F.trim("c").alias("c")).where(~F.col("c").rlike("(?i)^(PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|CHECK)\\b"))
    return rows.select(key, "table", "at", F.regexp_extract("c", r'^"?([A-Za-z0-9_#$@]+)"?', 1).alias("column"), F.upper(F.regexp_extract("c", r'^\S+\s+([A-Za-z]+(?:\s*\([^)]*\))?)', 1)).alias("type"), (~F.upper("c").contains("NOT NULL")).alias("nullable"))
