"""Where texts name things: all names of a table against all texts in one scan.

Texts are cut into words by Spark and joined with the names as keys, so neither
side has a bound and nothing is broadcast unless Spark has measured it.  A word
that a text repeats is one row before the join.

Edge cases: names and words are compared in upper case, with - and _ alike, as
whole words (letters, digits, - and _; a point between them belongs to the word
too, but a word counts for its part before the point as well).  Null and blank
names name nothing; names that are alike but for case or dashes are told apart
in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}][\p{L}\p{N}_-]*(?:\.[\p{L}\p{N}][\p{L}\p{N}_-]*)*"


def plain(name: Column) -> Column:
    return F.translate(F.upper(F.trim(name)), "_", "-")


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """name, key, n (how often), first_line and last_line, for each name and text that has it."""
    lines = texts.select(F.col(key).alias("_key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_line", "_x"))
    words = lines.select("_key", (F.col("_line") + 1).alias("_line"), F.explode(F.regexp_extract_all(plain(F.col("_x")), F.lit(WORD), F.lit(0))).alias("_w"))
    both = F.when(F.contains("_w", F.lit(".")), F.array("_w", F.substring_index("_w", ".", 1))).otherwise(F.array("_w"))
    words = words.select("_key", "_line", F.explode(both).alias("_w")).groupBy("_key", "_w").agg(F.count("*").alias("n"), F.min("_line").alias("first_line"), F.max("_line").alias("last_line"))
    known = names.select(F.col(name).alias("name"), plain(F.col(name)).alias("_w")).where("_w <> ''").distinct()
    return words.join(known, "_w").select("name", F.col("_key").alias(key), "n", "first_line", "last_line")


def capped(found: DataFrame, key: str, most: int) -> DataFrame:
    """For each name its first texts, by how often they name it and then by key, with their rank and how many there are in all."""
    by = Window.partitionBy("name")
    rank = F.row_number().over(by.orderBy(F.desc("n"), key))
    return found.withColumns({"rank": rank, "n_texts": F.count("*").over(by)}).where(F.col("rank") <= most)
