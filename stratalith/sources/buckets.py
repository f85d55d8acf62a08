"""Tables in buckets of their keys: an upsert rewrites only the buckets that it touches.

A table is a Parquet folder partitioned by the hash of its keys, always with the
same number of buckets.  An upsert reads the touched buckets, writes their new
rows to a folder beside the table, and puts them in place by Spark's dynamic
partition overwrite; if it breaks off after that folder is whole, ``resumed``
does the rest.

Edge cases: rows without any old ones are new; a batch with no rows touches
nothing; null keys are keys.  A batch that comes again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64
BUCKET = "_bucket"
#: The relations between components and the keys of their rows.
RELATIONS = {
    "program_calls": ["calling", "called", "line"], "copybook_uses": ["program", "copybook", "line"],
    "file_access": ["program", "file", "access_type", "line"], "field_xref": ["program", "field", "use", "line"],
}


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _put(spark: SparkSession, staged: str, path: str) -> None:
    spark.read.parquet(staged).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def resumed(spark: SparkSession, path: str) -> None:
    """Ends an upsert that broke off while it put its buckets in place; one that broke off before left the table as it was."""
    staged = path.rstrip("/") + ".staged"
    if _exists(spark, f"{staged}/_SUCCESS"):
        _put(spark, staged, path)


def table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table, None if there is none."""
    resumed(spark, path)
    return spark.read.parquet(path).drop(BUCKET) if _exists(spark, path) else None


def upsert(df: DataFrame, path: str, keys: list[str], version: str, buckets: int = BUCKETS) -> int:
    """Puts rows into a table and returns the number of buckets rewritten.

    Of old and new rows with the same keys those of the greatest version stay, all of them; of the same version the new ones.
    """
    spark, staged = df.sparkSession, path.rstrip("/") + ".staged"
    resumed(spark, path)
    new = df.withColumns({BUCKET: bucket_of(keys, buckets), "_new": F.lit(1)})
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
    if not touched:
        return 0
    rows = new
    if _exists(spark, path):
        old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))  # only these partitions are read
        rows = new.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.desc("_new")))
    rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_new").repartition(BUCKET).write.mode("overwrite").parquet(staged)
    _put(spark, staged, path)
    return len(touched)


def save_relation(df: DataFrame, folder: str, relation: str, version: str, buckets: int = BUCKETS) -> int:
    """An upsert into one of the tables of RELATIONS below a folder."""
    return upsert(df, f"{folder.rstrip('/')}/{relation}", RELATIONS[relation], version, buckets)


def update_index(df: DataFrame, path: str, file: str, version: str, buckets: int = BUCKETS) -> int:
    """Puts the vectors of changed files into an index: of each file the rows of its newest version stay, all others of it go.

    A deleted file has a row with its version and without a vector (a tombstone), which keeps older versions out.
    """
    return upsert(df, path, [file], version, buckets)


def index(spark: SparkSession, path: str, vector: str) -> DataFrame | None:
    """The vectors of an index, without tombstones."""
    rows = table(spark, path)
    return None if rows is None else rows.where(F.col(vector).isNotNull())


def follow(stream: DataFrame, update: Callable[[DataFrame], int], checkpoint: str) -> StreamingQuery:
    """Runs an update, such as update_index, on each batch that a stream has now; a batch that is repeated after a crash changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: update(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
