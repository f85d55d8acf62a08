"""Names, layouts and types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no field, and words that are no file.
KEYWORDS = ("IF", "THEN", "ELSE", "END", "MOVE", "TO", "FROM", "COMPUTE", "PERFORM", "UNTIL", "VARYING", "BY", "CALL", "USING", "RETURNING", "PIC", "PICTURE", "VALUE", "OCCURS", "REDEFINES", "DEPENDING")
NEVER_FILES = (
    "VALUE", "PIC", "PICTURE", "THE", "TO", "FROM", "INTO", "GIVING", "SPACES", "SPACE", "ZEROS", "ZEROES", "QUOTES", "HIGH-VALUES", "LOW-VALUES",
    "YES", "NO", "TRUE", "FALSE", "ON", "OFF", "ERROR", "OVERFLOW", "EQUAL", "GREATER", "LESS", "THAN", "OR", "AND", "NOT",
)
#: Heads and tails by which a longer name is a file's all the same.
FILE_HEADS = ("TMS", "FILE", "MST", "DTL", "HDR", "TRL", "MSTR", "DETAIL", "CUSTOMER", "ACCOUNT")
FILE_TAILS = ("FILE", "MST", "DTL", "HDR", "TRL", "DAT", "REC")


def clean_column(name: Column) -> Column:
    """Letters, digits and single underscores; a leading digit gets col_ before it."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]", "_"), "_+", "_"), "^_|_$", "")
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("col_"), c)).otherwise(c)


def clean_table(name: Column) -> Column:
    c = F.lower(clean_column(F.regexp_replace(name, "[.][A-Za-z0-9]+$", "")))
    return F.when(c.rlike("^[a-z]"), c).otherwise(F.concat(F.lit("tbl_"), c))


def clean_component(name: Column) -> Column:
    """Without folders, ending and the marks of temporary files."""
    c = F.regexp_replace(name, "^.*[/\\\\]", "")
    c = F.regexp_replace(c, "^(tmp[a-z0-9_]{8}_|temp_|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_|[0-9a-f]{16,}_)", "")
    return F.regexp_replace(c, "[.][A-Za-z0-9]{1,4}$", "")


def component_names(text: Column) -> Column:
    """Upper-case words of three letters or more, quoted names and what follows the word program."""
    upper = F.regexp_extract_all(text, F.lit("(?:^|[^A-Za-z0-9_-])([A-Z][A-Z0-9-]{2,})"), F.lit(1))
    quoted = F.regexp_extract_all(text, F.lit("\"([A-Za-z0-9_.-]+)\""), F.lit(1))
    after = F.regexp_extract_all(text, F.lit("(?i)program ([A-Za-z0-9_-]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(upper, quoted, after)))


def valid_field(name: Column) -> Column:
    u = F.upper(name)
    return (F.length(name) >= 2) & ~u.isin(*KEYWORDS) & F.regexp_replace(u, "[-_]", "").rlike("^[\\p{L}\\p{N}]+$")


def valid_file(name: Column, context: Column | None = None) -> Column:
    """Three to fifteen characters; longer with a head or tail of files, and up to thirty where the context is working storage or linkage."""
    u = F.upper(name)
    inside = F.upper(context).rlike("WORKING-STORAGE|LINKAGE") if context is not None else F.lit(False)
    known = u.rlike("^(" + "|".join(FILE_HEADS) + ")") | u.rlike("(" + "|".join(FILE_TAILS) + ")$")
    return (F.length(name) > 2) & ~u.isin(*NEVER_FILES) & u.rlike("^[A-Z][A-Z0-9-]*$") & ((F.length(name) <= 15) | known | (inside & (F.length(name) <= 30)))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def pic_symbols(pic: Column) -> Column:
    """A picture with its repeats written out: 9(3)V99 becomes 999V99."""
    parts = F.regexp_extract_all(F.upper(pic), F.lit("([A-Z9.,*+$-])(?:\\(([0-9]+)\\))?"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.contains(p, F.lit("(")), F.repeat(F.substring(p, 1, 1), F.regexp_extract(p, "\\(([0-9]+)\\)", 1).cast("int"))).otherwise(p)), "")


def pic_type(pic: Column, symbols: Column | None = None) -> Column:
    """The SQL type of a picture: DECIMAL(p,s) with a decimal point, INTEGER up to 9 digits, BIGINT up to 18, else VARCHAR(n)."""
    s = pic_symbols(pic) if symbols is None else symbols  # read many times: a column of its own, if given
    whole, fraction = F.split_part(s, F.lit("V"), F.lit(1)), F.split_part(s, F.lit("V"), F.lit(2))
    digits, decimals = F.regexp_count(whole, F.lit("[9Z]")), F.regexp_count(fraction, F.lit("[9Z]"))
    numeric = s.rlike("^S?[9Z]*V?[9Z]*$") & ((digits + decimals) > 0)
    return (
        F.when(numeric & (decimals > 0), F.concat(F.lit("DECIMAL("), digits + decimals, F.lit(","), decimals, F.lit(")")))
        .when(numeric & (digits <= 9), "INTEGER").when(numeric & (digits <= 18), "BIGINT")
        .when(numeric, F.concat(F.lit("DECIMAL("), digits, F.lit(",0)")))
        .otherwise(F.concat(F.lit("VARCHAR("), F.length(s), F.lit(")")))
    )


def pic_length(pic: Column) -> Column:
    """Bytes of a picture for display: every symbol but S and V."""
    return F.length(F.regexp_replace(pic_symbols(pic), "[SV]", ""))


def occurs(text: Column) -> Column:
    """min, max, depending_on and indexed_by of an OCCURS clause."""
    u = F.regexp_replace(F.upper(text), "\\s+", " ")
    a, b = F.regexp_extract(u, "OCCURS ([0-9]+)", 1), F.regexp_extract(u, "OCCURS [0-9]+ TO ([0-9]+)", 1)
    name = "([A-Z0-9][A-Z0-9-]*)"
    return F.when(u.rlike("OCCURS [0-9]+"), F.struct(
        a.cast("int").alias("min"), F.when(b != "", b).otherwise(a).cast("int").alias("max"),
        F.nullif(F.regexp_extract(u, f"DEPENDING ON {name}", 1), F.lit("")).alias("depending_on"), F.nullif(F.regexp_extract(u, f"INDEXED BY {name}", 1), F.lit("")).alias("indexed_by")))


def glob(name: Column, patterns: list[str]) -> Column:
    """Whether a name fits one of the shell patterns (* and ? alone are special)."""
    import re

    def regex(p: str) -> str:
        return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"

    return name.rlike("|".join(regex(p) for p in patterns))
