"""Quality rules: line frequency across documents, in DataFrame operations alone.

Lines are normalised (lower case, digits to 0, single blanks) and hashed.  For
each host the distinct documents that hold a line are counted; texts that are
equal count as one document, so that copies do not turn prose into
boilerplate.  Lines found in more than ``max_docs`` documents of their host are
removed; the limit is the same for hosts of any size.  A document is rejected
if it fails the base rules or if fewer than ``min_words`` words, or less than
``min_left`` of its words, are left.

Texts are read once: base columns and line hashes are written to a table, from
which the rest is joined.  Counts are partially aggregated before they are
shuffled, so a line of a third of all documents is one row of each task;
counting distinct documents deals by line and document first.  What is joined
by line or document is written first, so that Spark can split a hot key.

Edge cases: a null text has no words and no lines and fails the base rules; a
null source is a host of its own.  Repeated rows get the same result each.  A
text of any length is taken as a whole.  An empty table gives an empty result.
Columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, table

WIDTH = 8


def repeated_window_words(hashes: Column, keys: Column) -> Column:
    """How many words lie in windows that occur twice or more.

    hashes: one for each window, in order; keys: sorted structs (h, i) of them,
    empty if no hash repeats.
    """
    last = F.size(keys) - 1
    again = F.filter(keys, lambda e, k: ((k > 0) & (F.get(keys, k - 1)["h"] == e["h"])) | ((k < last) & (F.get(keys, k + 1)["h"] == e["h"])))
    at = F.array_sort(F.transform(again, lambda e: e["i"]))
    zero = F.struct(F.lit(-WIDTH).alias("before"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(at, zero, lambda acc, i: F.struct(i.alias("before"), (acc["n"] + F.least(F.lit(WIDTH), i - acc["before"])).alias("n")), lambda acc: acc["n"])


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to a table with a text without nulls."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    word = F.transform(F.array_remove(F.split(text, SPACE + "+"), ""), lambda w: F.xxhash64(w))
    out = docs.withColumns({"_lines": lines, "_words": word})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") < WIDTH, F.array().cast("array<long>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("_words") - WIDTH), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WIDTH)]))),
    })
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("_keys", F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    out = out.withColumn("n_repeat_words", repeated_window_words(F.col("_windows"), F.col("_keys")))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).drop("_lines", "_words", "_windows", "_keys")


def line_hash(line: Column) -> Column:
    low = F.regexp_replace(F.lower(line), "[0-9]", "0")
    return F.xxhash64(F.trim(F.regexp_replace(low, SPACE + "+", " ")))


def quality_rules(docs: DataFrame, max_docs: int = 5, min_words: int = 20, min_left: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, the base columns, n_removed_words (in frequent lines), base_failed, kept, and removed_lines (their numbers)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))
    rows = rows.withColumns({"k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "k2": F.xxhash64("text", "host")})
    words = lambda line: F.size(F.array_remove(F.split(line, SPACE + "+"), "")).cast("long")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(line_hash(x).alias("line"), words(x).alias("words")))
    rows = table(base_columns(rows.withColumn("lines", lines)).drop("text"), "lines")
    lines = rows.select("host", "k1", "k2", F.posexplode("lines").alias("at", "x")).select("host", "k1", "k2", "at", "x.line", "x.words").where("words > 0")
    often = table(lines.groupBy("host", "line").agg(F.count_distinct("k2").alias("n")).where(F.col("n") > max_docs).select("host", "line"), "often")
    found = lines.join(often, ["host", "line"]).groupBy("k1", "k2", "at").agg(F.max("words").alias("words"))
    lost = table(found.groupBy("k1", "k2").agg(F.sum("words").alias("lost"), F.sort_array(F.collect_list("at")).alias("ats")), "lost")
    out = rows.join(lost, ["k1", "k2"], "left")
    out = out.withColumn("n_removed_words", F.coalesce("lost", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed",
                      (~F.col("base_failed") & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
                      F.coalesce("ats", F.array().cast("array<int>")).alias("removed_lines"), "k2")


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, all columns, without their frequent lines; n_chars, if there, is counted anew.

    Rows that repeat an id and text are one row of the result.
    """
    rules = quality_rules(docs, **limits).where("kept").groupBy("doc_id", "k2").agg(F.first("removed_lines").alias("_gone")).withColumnsRenamed({"doc_id": "_id", "k2": "_text"})
    rows = docs.withColumns({"_host": F.coalesce(F.col("source").cast("string"), F.lit("")), "_key": F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))})
    rows = rows.join(rules, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text"))).dropDuplicates(["_id", "_key"])
    out = rows.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: With the parameters' defaults.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT rid, unnest(list_transform(generate_series(1, len(ws) - 7), lambda i: array_to_string(list_slice(ws, i, i + 7), ' '))) AS x, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM u) WHERE c > 1),
c AS (SELECT rid, CAST(sum(least(8, i - coalesce(b, i - 8))) AS BIGINT) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS b FROM r) GROUP BY rid),
l AS (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT rid, host, t, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
o AS (SELECT host, norm FROM m GROUP BY host, norm HAVING count(DISTINCT t) > 5),
x AS (SELECT rid, CAST(sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS lost FROM m JOIN o USING (host, norm) GROUP BY rid),
k AS (SELECT rid, count(*) - count(DISTINCT line) AS dup FROM m GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 coalesce(dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(lost, 0) AS n_removed_words FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN k USING (rid) LEFT JOIN x USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM b
"""
