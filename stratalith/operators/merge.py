"""Merging of analyses: values of any JSON type by key.

Edge cases: a text that is no JSON object counts as one without keys.  Null values are values like others; of mixed
ones the first counts.  An empty list adds nothing, so a key that has only these is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(rows: DataFrame, key: str, json: str, order: list[str | Column]) -> DataFrame:
    """One row for each key and name in its JSON objects: key, name, rule, n, texts, mean, first.

    Lists are taken apart.  If all values are texts (rule texts), the distinct ones are told, sorted; if all are numbers,
    truth values among them (mean), their mean; of others (first) the first by order, as JSON.
    """
    parsed = F.from_json(F.when(F.try_parse_json(json).isNotNull(), F.col(json)), "map<string,variant>")
    each = rows.select(F.col(key).alias("_key"), F.struct(*order).alias("_at"), F.explode(parsed).alias("name", "_v"))
    kind = F.schema_of_variant("_v")
    parts = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    each = each.select("_key", "_at", "name", F.posexplode(parts).alias("_i", "_v")).withColumn("_t", F.schema_of_variant("_v"))
    text, truth = F.col("_t") == "STRING", F.col("_t") == "BOOLEAN"
    number = truth | F.col("_t").isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith("_t", F.lit("DECIMAL"))
    value = F.when(truth, F.try_variant_get("_v", "$", "boolean").cast("double")).otherwise(F.try_variant_get("_v", "$", "double"))
    found = each.groupBy("_key", "name").agg(
        F.count("*").alias("n"), F.bool_and(text).alias("_texts"), F.bool_and(number).alias("_numbers"), F.collect_set(F.when(text, F.try_variant_get("_v", "$", "string"))).alias("_s"),
        F.avg(F.when(number, value)).alias("_mean"), F.min(F.struct("_at", "_i", F.to_json("_v").alias("j"))).alias("_f"))
    rule = F.when(F.col("_texts"), "texts").when(F.col("_numbers"), "mean").otherwise("first")
    return found.select(F.col("_key").alias(key), "name", rule.alias("rule"), "n", F.when(F.col("_texts"), F.array_sort("_s")).alias("texts"), F.when(F.col("_numbers"), F.col("_mean")).alias("mean"),
                        F.when(~F.col("_texts") & ~F.col("_numbers"), F.col("_f.j")).alias("first"))
