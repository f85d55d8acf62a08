"""Scores and classes of components as column expressions.

The numbers and word lists here are fixed values: results have to equal those
of the system whose reports this engine reproduces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column, *words: str) -> Column:
    """How often whole words occur, whatever the case.  Letters, digits and _ make words; both ends are ASCII."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.upper(text), "[^A-Z0-9_]", "  "), F.lit(" "))
    return F.regexp_count(padded, F.lit(" (" + "|".join(w.upper() for w in words) + ") "))


def phrase_count(text: Column, phrase: str) -> Column:
    """How often a phrase occurs in upper-cased text whose white space is single blanks."""
    flat = F.regexp_replace(F.upper(text), "\\s+", " ")
    return F.regexp_count(flat, F.lit(phrase))


def sql_complexity(sql: Column) -> Column:
    """Points for statements, joins, subqueries, grouping, ordering, windows and CTEs; 20 at most."""
    def n(p: str) -> Column:
        return phrase_count(sql, p)

    points = (
        F.when((n("SELECT") > 0), 1).otherwise(0) + F.when(n("INSERT") > 0, 1).otherwise(0)
        + F.when(n("UPDATE") > 0, 2).otherwise(0) + F.when(n("DELETE") > 0, 2).otherwise(0)
        + n("JOIN") * 2 + n("INNER JOIN") + n("LEFT JOIN") * 2 + n("RIGHT JOIN") * 2 + n("FULL JOIN") * 3
        + n("\\( ?SELECT") * 3 + n("GROUP BY") * 2 + n("HAVING") * 2 + n("ORDER BY") + n("OVER ?\\(") * 3 + F.when(n("WITH ") > 0, 2).otherwise(0)
    )
    return F.least(points, F.lit(20))


def complexity(text: Column) -> Column:
    """1 + decisions + half the lines with IF or PERFORM, 10 at most.

    Ends such as END-IF count as decisions here; ``complexity_strict`` leaves
    them out and measures nesting.
    """
    decisions = word_count(text, "IF", "WHEN", "PERFORM", "UNTIL", "WHILE", "CASE")
    by_line = F.replace(F.regexp_replace(F.upper(text), "[^A-Z0-9_\n]", "  "), F.lit("\n"), F.lit(" \n "))
    nested = F.regexp_count(F.concat(F.lit(" "), by_line, F.lit(" ")), F.lit(" (?:IF|PERFORM) [^\n]*"))  # the first of a line, and what follows it there
    return F.least(F.lit(10.0), 1 + decisions + 0.5 * nested)


def complexity_strict(text: Column) -> Column:
    from ..operators.ordered import deepest

    bare = F.regexp_replace(F.upper(text), "END-(IF|PERFORM|EVALUATE)", "~")
    decisions = word_count(bare, "IF", "WHEN", "PERFORM", "UNTIL", "WHILE", "CASE")
    marks = F.transform(F.split(bare, "\n"), lambda x: F.when(word_count(x, "IF", "PERFORM") > 0, 1).when(F.contains(x, F.lit("~")), -1).otherwise(0))
    return F.least(F.lit(10.0), 1 + decisions + 0.5 * deepest(marks))


def maintainability(mean: Column, error_ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), 8 - 0.5 * F.greatest(F.lit(0.0), mean - 3) + 2 * error_ratio))


def variance(value: Column) -> Column:
    """The population variance of whole numbers, from whole sums: the same however the rows are dealt to tasks, so a test against a bound is exact."""
    n, total = F.count(value), F.sum(value)
    return (n * F.sum(value * value) - total * total) / (n * n)


def code_quality(comment_ratio: Column, mean: Column, variance: Column) -> Column:
    score = (
        F.lit(5.0) + F.when(comment_ratio > 0.1, F.least(F.lit(2.0), 5 * comment_ratio)).otherwise(0.0)
        - F.when(mean > 5, F.least(F.lit(3.0), 0.5 * (mean - 5))).otherwise(0.0) + F.when(variance < 2, 1.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))


def rating(score: Column) -> Column:
    return F.when(score < 3, "Low").when(score < 7, "Medium").when(score < 12, "High").otherwise("Very High")


def component_complexity(lines: Column, cyclomatic: Column, file_ops: Column, fields: Column) -> Column:
    return 0.1 * lines + 5 * cyclomatic + 2 * file_ops + 0.5 * fields


#: Signs of code (any case) and of structured text, operators that are tokens of their own, and characters to a token.
CODE_SIGNS = (
    "{", "}", "(", ")", "[", "]", ";", "function", "class", "def", "if", "else", "for", "while", "IDENTIFICATION DIVISION", "PROCEDURE DIVISION", "DATA DIVISION",
    "EXEC CICS", "EXEC SQL", "PERFORM", "MOVE", "CALL", "//", "EXEC", "DD", "JOB", "STEP",
)
SURE_CODE_SIGNS = ("IDENTIFICATION DIVISION", "PROCEDURE DIVISION", "EXEC CICS", "EXEC SQL")
STRUCTURED_SIGNS = ('{"', '"}', '":', '",', "[{", "}]", "<", ">", "<?xml", "</", "/>", "<!--", "PIC ", "OCCURS ", "REDEFINES ", "01 ", "05 ")
OPERATOR_SIGNS = ("==", "!=", "<=", ">=", "->", "=>", "++", "--", "&&", "||", "**", "//", "/*", "*/", "<!--", "-->")
CHARACTERS_PER_TOKEN = {"code": 3.2, "structured": 3.8, "prose": 4.2}


def signs(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def one_case(text: Column) -> Column:
    """Upper case of the letters that have an ASCII one, a character for a character as SQL has it: upper() makes SS of a sharp s and finds CLASS where no such word is."""
    small = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, small + "\u0131\u017f", small.upper() + "IS")


def estimated_tokens(text: Column) -> Column:
    """Characters by those to a token of code, structured text or prose, with additions for marks, short words, line ends and operators.

    Between a tenth of the length (1 at least) and the length; 0 for no text.
    """
    from ..operators.program import bound

    blank = r"\s\x0B\x1C-\x1F\x85\p{Z}"

    def counted(t: Column, upper: Column) -> Column:
        code = (signs(upper, tuple(w.upper() for w in CODE_SIGNS)) >= 3) | (signs(upper, SURE_CODE_SIGNS) > 0)
        per = F.when(code, CHARACTERS_PER_TOKEN["code"]).when(signs(t, STRUCTURED_SIGNS) >= 2, CHARACTERS_PER_TOKEN["structured"]).otherwise(CHARACTERS_PER_TOKEN["prose"])
        patterns = {"words": f"[^{blank}]+", "letters": r"[\p{L}\p{N}]", "marks": rf"[^\p{{L}}\p{{N}}{blank}]"}
        return F.struct(F.length(t).alias("n"), per.alias("per"), *(F.regexp_count(t, F.lit(x)).alias(k) for k, x in patterns.items()),
                        occurrences(t, "\n").alias("ends"), sum((occurrences(t, x) for x in OPERATOR_SIGNS), F.lit(0)).alias("operators"))

    def weighed(c: Column) -> Column:
        # one sum from left to right, operators counted before they are weighed: the floor below tells sums apart that differ in their last bit
        n, words, marks = c["n"], c["words"], c["marks"]
        whole = n / c["per"] + F.when(marks / n > 0.1, marks * 0.3).otherwise(0.0) + F.when((words > 0) & (c["letters"] / words < 4), words * 0.1).otherwise(0.0) + c["ends"] * 0.5 + c["operators"] * 0.5
        return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 10), F.least(F.floor(whole), n))).cast("long")

    # each is bound, or Spark would work the text's case and counts out again for each use
    return bound(F.coalesce(text, F.lit("")), lambda t: bound(one_case(t), lambda upper: bound(counted(t, upper), weighed)))


#: The first domain one of whose words occurs in a name wins.
DOMAINS = (
    ("financial", ("AMOUNT", "AMT", "BALANCE", "BAL", "RATE", "FEE", "COST", "PRICE")), ("temporal", ("DATE", "TIME", "TIMESTAMP", "DT", "TM", "YEAR", "MONTH", "DAY")),
    ("customer", ("CUSTOMER", "CUST", "CLIENT", "NAME", "ADDR", "ADDRESS", "PHONE", "EMAIL")), ("account", ("ACCOUNT", "ACCT", "ACC", "NUMBER", "NUM", "ID", "IDENTIFIER")),
    ("transaction", ("TRANS", "TXN", "TRANSACTION", "PAYMENT", "TRANSFER")), ("control", ("STATUS", "STAT", "FLAG", "IND", "INDICATOR", "CODE", "TYPE")),
    ("product", ("PRODUCT", "PROD", "ITEM", "SERVICE", "SVC")), ("location", ("BRANCH", "LOCATION", "LOC", "REGION", "AREA", "ZONE")),
)
#: The domains of the reports in upper case, in their own order.
REPORT_DOMAINS = (
    ("CUSTOMER", ("CUST", "CUSTOMER", "CLIENT")), ("FINANCIAL", ("AMT", "AMOUNT", "BAL", "BALANCE", "RATE", "FEE")), ("ACCOUNT", ("ACCT", "ACCOUNT", "ACC")),
    ("TEMPORAL", ("DATE", "TIME", "TIMESTAMP", "DT")), ("TRANSACTION", ("TXN", "TRANS", "TRANSACTION")), ("ADDRESS", ("ADDR", "ADDRESS", "STREET", "CITY", "STATE", "ZIP")),
)


def first_match(text: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The first class one of whose words is contained in the upper-cased text."""
    out = None
    for name, words in classes:
        hit = F.upper(text).rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def domain(name: Column) -> Column:
    return first_match(name, DOMAINS, "general")


def report_domain(name: Column) -> Column:
    return first_match(name, REPORT_DOMAINS, "GENERAL")


#: Patterns of what a chat question asks for; a class has a point for each pattern that is found.
INTENTS = (
    ("analysis", ("analyze|analysis|examine|investigate|study", "what (is|are|does)|how (does|is|are)", "explain|describe|tell me about", "show me|find|search for")),
    ("lineage", ("trace|lineage|flow|path|journey", "where (is|does|comes|goes)", "source|destination|origin", "upstream|downstream|dependencies")),
    ("comparison", ("compare|difference|similar|contrast", "versus|vs|against|between", "same|different|alike")),
    ("impact", ("impact|effect|affect|change", "what happens if|what if", "consequences|result|outcome")),
    ("search", ("find|search|look for|locate", "contains|includes|has", "pattern|like|similar to")),
)


def best_class(text: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """The class with most patterns found, the first on ties, the default without any."""
    low = F.lower(text)
    counts = [sum((low.rlike(w).cast("int") for w in words), F.lit(0)) for _, words in classes]
    most = F.greatest(*counts)
    out = F.when(F.coalesce(most, F.lit(0)) == 0, default)
    for (name, _), n in zip(classes, counts, strict=True):
        out = out.when(n == most, name)
    return out


def intent(text: Column) -> Column:
    return best_class(text, INTENTS, "general")


def usage_pattern(defined: Column, reads: Column, writes: Column) -> Column:
    """From whether a field is defined and how often it is read and written."""
    return F.when(defined & ((reads > 0) | (writes > 0)), "ACTIVE_FIELD").when(reads > writes, "READ_MOSTLY").when(writes > reads, "WRITE_MOSTLY").otherwise("BALANCED_USAGE")


def lifecycle_stage(kinds: Column) -> Column:
    """From the set of a field's operations."""
    def has(*names: str) -> Column:
        return F.arrays_overlap(kinds, F.array(*map(F.lit, names)))

    return F.when(has("DEFINE") & has("WRITE", "UPDATE"), "ACTIVE").when(has("DEFINE"), "DEFINED").when(has("READ", "REFERENCE"), "USED").otherwise("UNKNOWN")


def risk(programs: Column, critical: Column) -> Column:
    return F.when((programs > 5) | (critical > 3), "HIGH").when((programs > 2) | (critical > 1), "MEDIUM").otherwise("LOW")


#: What each stage adds to the completeness of a lifecycle.
STAGE_WEIGHTS = {"creation": 0.2, "population": 0.15, "active_usage": 0.25, "updates": 0.15, "archival": 0.1, "purging": 0.05, "backup": 0.05, "recovery": 0.03, "migration": 0.02}
#: The stage of each operation.
STAGE_OF = {"CREATE": "creation", "WRITE": "population", "READ": "active_usage", "UPDATE": "updates", "REWRITE": "updates", "DELETE": "updates", "COPY": "migration", "ARCHIVE": "archival", "PURGE": "purging", "BACKUP": "backup", "RESTORE": "recovery"}


def mapped(value: Column, table: dict, default: object = None) -> Column:
    out = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[value]
    return F.coalesce(out, F.lit(default)) if default is not None else out


def completeness(stages: Column) -> Column:
    return F.aggregate(F.array_distinct(stages), F.lit(0.0), lambda acc, s: acc + mapped(s, STAGE_WEIGHTS, 0.0))


def flow_level(points: Column) -> Column:
    return F.when(points <= 5, "Low").when(points <= 15, "Medium").when(points <= 30, "High").otherwise("Very High")


def integration(db2: Column, cics: Column, other: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 * db2 + 0.3 * cics + 0.2 * other)


def system_risk(high_share: Column, schema_match: Column, data_match: Column) -> Column:
    points = F.when(high_share > 0.3, 3).otherwise(0) + F.when(schema_match < 0.7, 2).otherwise(0) + F.when(data_match < 0.8, 2).otherwise(0)
    return F.when(points >= 6, "HIGH").when(points >= 3, "MEDIUM").otherwise("LOW")


def severity(value: Column, warning: Column, critical: Column) -> Column:
    return F.when(value >= critical, "critical").when(value >= warning, "warning")


def recommendations(rules: list[tuple[Column, str]]) -> Column:
    """The texts of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))


#: Words of the questions that the lighter chat knows, in the order they are looked for.
CHAT_INTENTS = (
    ("cics_lifecycle", ("cics", "transaction", "terminal", "map", "commarea")), ("db2_lifecycle", ("db2", "sql", "database", "table", "query", "cursor")),
    ("complete_lifecycle", ("complete lifecycle", "full lifecycle", "system lifecycle", "end to end")), ("component_analysis", ("analyze", "analysis", "what does", "explain")),
    ("field_lineage", ("lineage", "trace", "flow", "where is", "used by")), ("file_lifecycle", ("lifecycle", "created", "updated", "dependencies")), ("code_search", ("find", "search", "show me", "locate")),
)
#: The standard type of each spelling; anything else is cobol.
COMPONENT_TYPES = {
    "cbl": "cobol", "cob": "cobol", "cobol": "cobol", "program": "cobol", "copy": "copybook", "cpy": "copybook", "copybook": "copybook",
    "jcl": "jcl", "job": "jcl", "proc": "jcl", "field": "field", "data_field": "field", "variable": "field",
}
#: Patterns of kinds of components, two of which have to be found, and what each kind is called; endings come first.
COMPONENT_PATTERNS = (
    ("PROGRAM", "COBOL", (r"IDENTIFICATION\s+DIVISION", r"PROGRAM-ID\s*\.", r"DATA\s+DIVISION", r"PROCEDURE\s+DIVISION")), ("JOB", "JCL", (r"^//\w+\s+JOB\s+", r"^//\w+\s+EXEC\s+PGM=", r"^//\w+\s+DD\s+")),
    ("COPYBOOK", "COBOL", (r"^\s*\d+\s+\w+\s+PIC", r"^\s*\d+\s+FILLER", r"COPY\s+REPLACING")), ("TABLE", "DB2", (r"CREATE\s+TABLE", r"SELECT.*FROM", r"INSERT\s+INTO", r"EXEC\s+SQL")),
    ("MAP", "CICS", ("DFHMSD", "DFHMDI", "DFHMDF")), ("FILE", "VSAM", (r"DEFINE\s+CLUSTER", r"DEFINE\s+AIX", "LISTCAT")),
)
COMPONENT_ENDINGS = (("PROGRAM", "COBOL", ("CBL", "COB", "COBOL")), ("JOB", "JCL", ("JCL", "JOB")), ("COPYBOOK", "COBOL", ("CPY", "COPY")), ("TABLE", "DB2", ("SQL", "DDL")))
#: Sizes below and above which a source is easy or hard, by kind, and the weight of each word.
EASY_HARD = {"db2_procedure": (500, 2000), "cobol_stored_procedure": (500, 2000), "mq_program": (1000, 3000), "cics": (1000, 3000)}
EASY_HARD_DEFAULT = (800, 2500)
EFFORT_WORDS = {"PERFORM": 1, "IF": 1, "EVALUATE": 2, "EXEC SQL": 1, "EXEC CICS": 1}


def chat_intent(text: Column) -> Column:
    """The first class one of whose words is contained."""
    low, out = F.lower(text), F.when(F.lit(False), "")
    for name, words in CHAT_INTENTS:
        out = out.when(low.rlike("|".join(words)), name)
    return out.otherwise("general")


def component_type(name: Column) -> Column:
    return mapped(F.lower(F.coalesce(name, F.lit(""))), COMPONENT_TYPES, "cobol")


def component_kind(text: Column, name: Column) -> Column:
    """type and subtype of a component: by its ending, else by two patterns of one kind; UNKNOWN otherwise."""
    ending, u = F.upper(F.regexp_extract(name, r"[.]([^.]+)$", 1)), F.upper(F.coalesce(text, F.lit("")))

    def struct(kind: str, subtype: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(subtype).alias("subtype"))

    out = F.when(F.lit(False), struct("", ""))
    for kind, subtype, endings in COMPONENT_ENDINGS:
        out = out.when(ending.isin(*endings), struct(kind, subtype))
    for kind, subtype, patterns in COMPONENT_PATTERNS:
        out = out.when(sum((u.rlike("(?m)" + p).cast("int") for p in patterns), F.lit(0)) >= 2, struct(kind, subtype))
    return out.otherwise(struct("UNKNOWN", "UNKNOWN"))


def effort(text: Column, kind: Column) -> Column:
    """low, medium or high, by the size of a source and words that make work."""
    u, n = F.upper(text), F.length(text)
    points = sum((occurrences(u, w) * k for w, k in EFFORT_WORDS.items()), F.lit(0))
    easy, hard = (mapped(kind, {k: v[i] for k, v in EASY_HARD.items()}, EASY_HARD_DEFAULT[i]) for i in (0, 1))
    return F.when((n < easy) & (points < 10), "low").when((n > hard) | (points > 25), "high").otherwise("medium")


def integration_level(operations: Column) -> Column:
    return F.when(operations == 0, "None").when(operations <= 2, "Low").when(operations <= 5, "Medium").otherwise("High")


def exchange_risk(to_db2: Column, from_db2: Column) -> Column:
    return (F.when((to_db2 > 0) & (from_db2 > 0), "High - Bidirectional sync").when((to_db2 > 2) | (from_db2 > 2), "Medium - Multiple operations")
            .when((to_db2 > 0) | (from_db2 > 0), "Low - Simple integration").otherwise("None"))


def component_advice(divisions: Column, has_storage: Column, unused: Column, lines: Column) -> Column:
    """What to do about a component, in order; three general hints where nothing is wrong."""
    found = F.array_compact(F.array(
        F.when(divisions > 5, F.lit("Consider breaking down large procedure divisions into smaller, focused modules")), F.when(~has_storage, F.lit("No working storage section found - verify data definitions")),
        F.when(unused > 5, F.concat(F.lit("Found "), unused.cast("string"), F.lit(" potentially unused fields - consider cleanup"))), F.when(lines > 1000, F.lit("Large component detected - consider modularization for better maintainability"))))
    hints = F.array(*map(F.lit, ("Component structure appears well-organized", "Consider adding comprehensive error handling if not present", "Ensure proper documentation for business logic sections")))
    return F.when(F.size(found) > 0, found).otherwise(hints)
