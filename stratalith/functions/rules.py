"""Ordered rules over names and texts: purposes, meanings, patterns.

Word lists and sentences marked so are fixed values: reports are compared by them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import first_match

#: Purposes of host variables by name; then by picture.
HOST_PURPOSES = (
    ("customer_data", ("CUSTOMER", "CUST")), ("order_data", ("ORDER", "ORD")), ("account_data", ("ACCOUNT", "ACCT")), ("transaction_data", ("TRANS", "TXN")),
    ("indicator_variables", ("IND", "NULL")), ("working_variables", ("WORK", "TEMP")),
)
#: What is said of a file by its name and what is done to it.
FILE_CONTEXTS = (
    (("CUSTOMER", "CUST"), "Customer data {} for CRM operations"), (("ACCOUNT", "ACCT"), "Account {} for financial processing"), (("TRANSACTION", "TXN"), "Transaction {} for payment processing"),
    (("BALANCE",), "Balance {} for accounting operations"), (("MASTER",), "Master data {} for reference management"), (("TEMP", "WORK"), "Temporary {} for intermediate processing"),
)
#: What an OCCURS is for, with its count.
OCCURS_PURPOSES = (
    (("TRANSACTION", "TXN"), "Transaction history array ({} transactions max)"), (("BALANCE",), "Multi-currency or multi-account balance array ({} entries)"),
    (("ADDRESS",), "Multiple address lines ({} lines max)"), (("PHONE",), "Multiple phone numbers ({} numbers max)"),
)
#: What a field means; all words of one of the groups have to occur.
FIELD_MEANINGS = (
    ((("CUSTOMER", "ID"),), "Customer identification for CRM and transaction tracking"), ((("ACCOUNT", "NUM"), ("ACCOUNT", "ID")), "Account number for financial transaction processing"),
    ((("BALANCE",),), "Financial balance for accounting and reporting"), ((("DATE",),), "Date field for temporal tracking and reporting"), ((("AMOUNT",),), "Monetary amount for financial calculations"),
    ((("STATUS",),), "Status indicator for workflow and business rule processing"), ((("NAME",),), "Name field for identification and correspondence"),
)


def _contains(text: Column, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(F.upper(text), F.lit(w))
    return out


def _worded(name: Column, rules: tuple, value: Column, default: str) -> Column:
    """The sentence of the first rule one of whose words the name contains, with the value in its place."""
    def said(sentence: str) -> Column:
        before, after = sentence.split("{}")
        return F.concat(F.lit(before), value, F.lit(after))

    out = F.when(F.lit(False), "")
    for words, sentence in rules:
        out = out.when(F.upper(name).rlike("|".join(words)), said(sentence))
    return out.otherwise(said(default))


def host_purpose(name: Column, definition: Column) -> Column:
    by_picture = F.when(_contains(definition, "PIC S9"), "numeric_data").when(_contains(definition, "PIC X"), "character_data").otherwise("general_purpose")
    known = (F.coalesce(name, F.lit("")) != "") & (F.coalesce(definition, F.lit("")) != "")
    by_name = first_match(name, HOST_PURPOSES, "")
    return F.when(~known, "general_purpose").when(by_name != "", by_name).otherwise(by_picture)


def field_meaning(name: Column, picture: Column) -> Column:
    from .names import pic_length

    out = F.when(F.lit(False), "")
    for groups, sentence in FIELD_MEANINGS:
        hit = F.lit(False)
        for words in groups:
            hit = hit | _contains(name, *words)
        out = out.when(hit, sentence)
    text = F.concat(F.lit("Text/character data ("), pic_length(picture), F.lit(" chars max)"))
    return out.when(F.contains(picture, F.lit("X")), text).when(F.contains(picture, F.lit("9")), "Numeric data for calculations and processing").otherwise("Business data field for operational processing")


def file_context(name: Column, operation: Column) -> Column:
    return _worded(name, FILE_CONTEXTS, F.lower(operation), "File {} operation")


def redefines_purpose(name: Column, redefined: Column) -> Column:
    return (F.when(_contains(name, "DATE") & _contains(redefined, "DATE"), "Date format conversion (YYYYMMDD vs DD/MM/YYYY)")
            .when(_contains(name, "AMOUNT") | _contains(name, "BALANCE"), "Financial amount format conversion (signed vs unsigned)")
            .when(_contains(name, "CODE"), "Code interpretation (numeric vs character representation)")
            .otherwise("Data format transformation for different processing needs"))


def occurs_purpose(name: Column, count: Column) -> Column:
    return _worded(name, OCCURS_PURPOSES, count.cast("string"), "Repeating data structure for bulk processing ({} entries)")


def logic_patterns(text: Column) -> Column:
    """Which of six kinds of logic a text shows, sorted."""
    u = F.upper(text)
    kinds = {"calculations": "COMPUTE|ADD |SUBTRACT|MULTIPLY|DIVIDE", "conditional": "IF |EVALUATE", "error_handling": "ON ERROR|INVALID KEY|AT END|SQLCODE", "file_operations": "READ |WRITE |OPEN |CLOSE ", "loops": "PERFORM.*UNTIL|PERFORM.*VARYING", "validation": "NUMERIC|ALPHABETIC|VALID"}
    return F.array_compact(F.array(*[F.when(u.rlike(p), F.lit(k)) for k, p in kinds.items()]))


def processing_kind(text: Column, file_ops: Column) -> Column:
    """batch, online, reporting or mixed."""
    u = F.upper(text)
    return F.when(u.rlike("EXEC CICS"), "online").when(u.rlike("REPORT|PRINT"), "reporting").when(file_ops > 5, "batch").otherwise("mixed")


def valid_chunk(text: Column) -> Column:
    """Ten characters at least and one line that is no comment."""
    return (F.length(F.trim(text)) >= 10) & F.exists(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("*")))


def chunk_id(program: Column, kind: Column, text: Column, most: int = 60) -> Column:
    """A readable id of bounded length that tells different contents apart."""
    return F.concat(F.substring(F.regexp_replace(F.concat_ws("_", program, kind), "[^A-Za-z0-9_]", "_"), 1, most), F.lit("_"), F.substring(F.md5(text), 1, 8))


def salvaged_json(text: Column) -> Column:
    """The JSON object inside an answer, or null if what stands between the outer braces is none."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    repaired = F.regexp_replace(F.regexp_replace(inner, r",\s*([}\]])", "$1"), "'", '"')
    return F.coalesce(_if_json(inner), _if_json(repaired))


def _if_json(text: Column) -> Column:
    return F.when((text != "") & F.try_parse_json(text).isNotNull(), text)


def sync_risk(directions: Column, programs: Column) -> Column:
    return F.when((directions > 1) & (programs > 3), "HIGH").when((directions > 1) | (programs > 3), "MEDIUM").otherwise("LOW")
