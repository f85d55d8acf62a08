"""Tables in Spark's catalogue, and what it knows of them after ANALYZE: columns, types, rows, nulls.

Edge cases: a table without rows has counts of 0 and no least or greatest value.  Columns whose type has no statistics
(lists, maps, structs) have nulls in their place.  Only names, types and statistics come to the driver, a row for each column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "table string, at int, column string, type string, n_rows long, n_nulls long, least string, greatest string, longest long"
_PLAIN = re.compile("boolean|tinyint|smallint|int|bigint|float|double|decimal.*|string|binary|date|timestamp.*")


def register(spark: SparkSession, names: dict[str, str], schema: str = "default") -> None:
    """Puts Parquet folders into the catalogue under names; the files stay where they are."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    for name, path in names.items():
        spark.sql(f"DROP TABLE IF EXISTS `{schema}`.`{name}`")
        spark.catalog.createTable(f"`{schema}`.`{name}`", path=path, source="parquet")


def scan(spark: SparkSession, schema: str = "default", like: str = "*") -> DataFrame:
    """Counts the tables whose names match (with * for any letters) and returns a row for each column; see SCHEMA."""
    out = []
    for (name,) in [(t.name,) for t in spark.catalog.listTables(schema, like) if not t.isTemporary]:
        full = f"`{schema}`.`{name}`"
        columns = [(f.name, f.dataType.simpleString()) for f in spark.table(full).schema]
        plain = [c for c, kind in columns if _PLAIN.fullmatch(kind)]
        spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(f'`{c}`' for c in plain)}" if plain else ""))
        rows = next((int(re.search(r"(\d+) rows", r["data_type"])[1]) for r in spark.sql(f"DESCRIBE EXTENDED {full}").collect() if r["col_name"] == "Statistics" and "rows" in r["data_type"]), None)
        for at, (column, kind) in enumerate(columns):
            known = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {full} `{column}`").collect()} if column in plain else {}
            known = {k: None if v == "NULL" else v for k, v in known.items()}
            number = lambda x: None if known.get(x) is None else int(known[x])  # noqa: B023, E731
            out.append((name, at, column, kind, rows, number("num_nulls"), known.get("min"), known.get("max"), number("max_col_len")))
    return spark.createDataFrame(out, SCHEMA)
