"""Expansion of copybooks into sources, with REPLACING, and where each line comes from.

Edge cases: a COPY of a book that is not there, or that is being expanded
already, stays as it stands and is told.  Names of books are compared in upper
case; of books with one name the least text counts.  A null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept
from .program import bound

_WORD = "[A-Z0-9-]"
_OPERAND = r"(?:==.*?==|'[^']*'|\"[^\"]*\"|[^\s=.'\"]+)"
_PAIR = rf"(?:(LEADING|TRAILING)\s+)?({_OPERAND})\s+BY\s+({_OPERAND})"
_ANY_PAIR = rf"(?:(?:LEADING|TRAILING)\s+)?{_OPERAND}\s+BY\s+{_OPERAND}"
COPY = rf"(?is)(?<![A-Z0-9'\"-])COPY\s+['\"]?([A-Z0-9][A-Z0-9_#@$-]*)['\"]?(?:\s+(?:OF|IN)\s+[A-Z0-9-]+)?(?:\s+REPLACING((?:\s+{_ANY_PAIR})+))?\s*\.(?=\s|$)"
#: What a parameter between double equal signs may be, tried apart, each with a group for its value.
PARAMETERS = {
    "variable": r"(?i)==([A-Z][A-Z0-9-]*)==", "literal": r"(?i)==(['\"][^']*['\"])==", "numeric": r"(?i)==(\d+)==", "pic": r"(?i)==PIC\s+([X9S()]+)==", "usage": r"(?i)==USAGE\s+([A-Z-]+)==",
}
GAP = 200


def counted(values: Column) -> Column:
    """For each of an array of ints the sum of all up to it."""
    return F.aggregate(values, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))


def _bare(operand: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(operand, r"(?s)^==(.*)==$", "$1"), r"\s+", " "))


def pairs(clause: Column) -> Column:
    """The replacements of a REPLACING clause: kind (LEADING, TRAILING or empty), old and new."""
    pattern = "(?is)" + _PAIR
    return F.transform(F.regexp_extract_all(F.coalesce(clause, F.lit("")), F.lit(pattern), F.lit(0)), lambda p: F.struct(
        F.upper(F.regexp_extract(p, pattern, 1)).alias("kind"), F.upper(_bare(F.regexp_extract(p, pattern, 2))).alias("old"), _bare(F.regexp_extract(p, pattern, 3)).alias("new")))


def replaced(text: Column, list_: Column) -> Column:
    """A text with all replacements of a list, in one pass: what was put in is not looked at again.

    Words are replaced as a whole unless LEADING or TRAILING says otherwise, or the replaced text begins or ends with
    a sign that no word has; blanks in it stand for any white space.
    """
    def pattern(p: Column) -> Column:
        body = F.concat(F.lit(r"\Q"), F.replace(p["old"], F.lit(" "), F.lit(r"\E\s+\Q")), F.lit(r"\E"))
        before = F.when(p["kind"] == "TRAILING", f"(?<={_WORD})").when((p["kind"] == "LEADING") | p["old"].rlike(f"^{_WORD}"), f"(?<!{_WORD})").otherwise("")
        behind = F.when(p["kind"] == "LEADING", f"(?={_WORD})").when((p["kind"] == "TRAILING") | p["old"].rlike(f"{_WORD}$"), f"(?!{_WORD})").otherwise("")
        return F.concat(F.lit("(?i:"), before, body, behind, F.lit(")"))

    def passed(some: Column) -> Column:
        def put(hit: Column) -> Column:
            return bound(F.upper(F.regexp_replace(hit, r"\s+", " ")), lambda plain: F.coalesce(F.get(F.filter(some, lambda p: p["old"] == plain), F.lit(0))["new"], F.lit("")))

        def by(either: Column) -> Column:
            each = F.arrays_zip(F.split(text, either).alias("part"), F.regexp_extract_all(text, either, F.lit(0)).alias("hit"))  # one part more than hits
            return F.array_join(F.transform(each, lambda z: F.concat(z["part"], F.when(z["hit"].isNull(), "").otherwise(put(z["hit"])))), "")

        return F.when(F.size(some) == 0, text).otherwise(bound(F.array_join(F.transform(some, pattern), "|"), by))

    # A pattern of its own for each text is dear, so only what the text can have is looked for.
    return bound(F.upper(text), lambda u: bound(F.filter(list_, lambda p: (p["old"] != "") & F.contains(u, F.substring_index(p["old"], " ", 1))), passed))


def _segments(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The texts (column text) cut at COPY statements: keep, i, is_copy, text, line (its first line), name and list of the COPY."""
    def ends(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    both = F.arrays_zip(F.split("text", COPY).alias("p"), F.regexp_extract_all("text", F.lit(COPY), F.lit(0)).alias("h"))
    cut = F.flatten(F.transform(both, lambda z: F.array(F.struct(F.lit(False).alias("is_copy"), z["p"].alias("text")), F.struct(F.lit(True).alias("is_copy"), F.coalesce(z["h"], F.lit("")).alias("text")))))
    sums = counted(F.transform(cut, lambda s: ends(s["text"])))
    placed = F.arrays_zip(cut.alias("s"), F.concat(F.array(F.lit(0)), F.slice(sums, 1, F.size(sums) - 1)).alias("n"))
    each = F.transform(placed, lambda z, i: F.struct(i.alias("i"), z["s"]["is_copy"].alias("is_copy"), z["s"]["text"].alias("text"), (z["n"] + 1).alias("line")))
    rows = rows.select(*keep, F.explode(F.filter(each, lambda s: s["text"] != "")).alias("s")).select(*keep, "s.*")
    is_copy = F.col("is_copy")
    return rows.withColumns({"name": F.when(is_copy, F.upper(F.regexp_extract("text", COPY, 1))), "list": F.when(is_copy, pairs(F.regexp_extract("text", COPY, 2)))})


def segments(sources: DataFrame, key: str, text: str, books: DataFrame) -> DataFrame:
    """The pieces of the expanded sources: key, at (orders them), text, book (null: the source itself), line (in its book), state.

    books: name and text.  state is text, missing or cycle.  Each round joins the COPY statements that are left with
    their books, so there are as many rounds as books are nested.  The replacements of a COPY hold for all that comes in by
    it, the inner ones first; a COPY statement in a book is itself not replaced in.
    """
    books = kept(books.groupBy(F.upper("name").alias("name")).agg(F.min(F.coalesce("text", F.lit(""))).alias("body")))
    lists = "array<array<struct<kind:string,old:string,new:string>>>"
    start = sources.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    columns = ["key", "at", "text", "book", "line", "state", "name", "lists", "chain"]
    rows = _segments(start, ["key"]).select("key", F.array("i").alias("at"), "text", F.lit(None).cast("string").alias("book"), "line", F.when(F.col("is_copy"), "copy").otherwise("text").alias("state"), "name",
                                            F.array("list").cast(lists).alias("lists"), F.array().cast("array<string>").alias("chain"))
    rows = kept(rows)
    done, open_ = rows.where("state = 'text'"), rows.where("state = 'copy'")
    while not open_.isEmpty():
        met = open_.join(books, "name", "left")
        state = F.when(F.array_contains("chain", F.col("name")), "cycle").when(F.col("body").isNull(), "missing").otherwise("copy")
        met = kept(met.withColumn("state", state))
        done = done.unionByName(met.where("state <> 'copy'").select(*columns))
        inner = met.where("state = 'copy'").select("key", "at", F.col("name").alias("book"), "lists", F.concat("chain", F.array("name")).alias("chain"), F.col("body").alias("text"))
        inner = _segments(inner, ["key", "at", "book", "lists", "chain"])
        text_ = F.when(F.col("is_copy"), F.col("text")).otherwise(F.aggregate("lists", F.col("text"), replaced))
        rows = kept(inner.select("key", F.concat("at", F.array("i")).alias("at"), text_.alias("text"), "book", "line", F.when(F.col("is_copy"), "copy").otherwise("text").alias("state"), "name",
                                 F.when(F.col("is_copy"), F.concat(F.array("list").cast(lists), F.col("lists"))).alias("lists"), "chain"))
        done, open_ = done.unionByName(rows.where("state = 'text'")), rows.where("state = 'copy'")
    return done.select(F.col("key").alias(key), "at", "text", "book", "line", "state", "name")


def expanded(pieces: DataFrame, key: str) -> DataFrame:
    """One row for each source of segments(): key, text, missing and cycles (names, sorted)."""
    found = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"), *(F.array_sort(F.collect_set(F.when(F.col("state") == s, F.col("name")))).alias(c) for s, c in (("missing", "missing"), ("cycle", "cycles"))))
    return found.select(key, F.array_join(F.col("p.text"), "").alias("text"), "missing", "cycles")


def line_map(pieces: DataFrame, key: str) -> DataFrame:
    """For each line of the expanded text that is not blank: key, line, book and book_line, of the first piece on it that is not blank."""
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    before = F.coalesce(F.sum(ends).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("_before", before).select(key, "at", "book", F.col("line").alias("_line"), "_before", F.posexplode(F.split("text", "\n")).alias("_k", "_x")).where("trim(_x) <> ''")
    first = F.min(F.struct("at", "_k", "book", (F.col("_line") + F.col("_k")).alias("book_line"))).alias("f")
    return rows.groupBy(key, (F.col("_before") + F.col("_k") + 1).alias("line")).agg(first).select(key, "line", "f.book", "f.book_line")


def replacing_groups(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Parameters between double equal signs, grouped where fewer than GAP characters lie between their beginnings: key, group, n, kinds, values, first, last (positions from 0)."""
    def found(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
        size = F.transform(F.arrays_zip(F.split("_t", pattern).alias("p"), hits.alias("h")), lambda z: F.length(z["p"]) + F.coalesce(F.length(z["h"]), F.lit(0)))
        ends = F.filter(F.arrays_zip(hits.alias("h"), counted(size).alias("e")), lambda z: z["h"].isNotNull())
        return F.transform(ends, lambda z: F.struct((z["e"] - F.length(z["h"])).alias("at"), F.lit(kind).alias("kind"), F.regexp_extract(z["h"], pattern, 1).alias("value")))

    rows = sources.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(key, F.explode(F.concat(*(found(*p) for p in PARAMETERS.items()))).alias("f")).select(key, "f.*")
    order = Window.partitionBy(key).orderBy("at", "kind")
    rows = rows.withColumn("_new", F.coalesce(F.col("at") - F.lag("at").over(order) >= GAP, F.lit(True))).withColumn("group", F.count_if(F.col("_new")).over(order))
    groups = rows.groupBy(key, "group").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "value"))).alias("p"))
    return groups.select(key, "group", F.size("p").alias("n"), F.array_sort(F.array_distinct(F.col("p.kind"))).alias("kinds"), F.col("p.value").alias("values"), F.col("p")[0]["at"].alias("first"), F.element_at("p", -1)["at"].alias("last"))
