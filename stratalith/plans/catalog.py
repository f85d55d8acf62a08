"""The named queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """A small table, dealt by its keys to as many tasks as a shuffle has.

    A text made of a row is some hundred times as large as the row in its file, which neither the splits of a scan nor the joining of
    small partitions know; without this a few tasks make and read all texts.  What is grouped by the keys later need not be shuffled again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def load() -> None:
    """Imports the modules that register queries."""
    from . import copybooks, documents, extract, ingest, lifecycle, lineage, monitor, ordered, program, programs, recon, relations, reports, search, sections, services, structures, summaries, text  # noqa: F401


load()
