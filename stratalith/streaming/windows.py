"""Windows, deduplication and state over streams; the window functions take batches as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keep import fresh


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder as a stream; event times become timestamps with a zone, as watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(there).isFile()
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def _timed(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, watermark) if watermark else df


def _summed(df: DataFrame, window: Column, key: str, value: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n", "total")


def tumbling(df: DataFrame, ts: str, size: str, key: str, value: str, watermark: str | None = None) -> DataFrame:
    return _summed(_timed(df, ts, watermark), F.window(ts, size), key, value)


def sliding(df: DataFrame, ts: str, size: str, step: str, key: str, value: str, watermark: str | None = None) -> DataFrame:
    return _summed(_timed(df, ts, watermark), F.window(ts, size, step), key, value)


def sessions(df: DataFrame, ts: str, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    out = _timed(df, ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def distinct(df: DataFrame, ts: str, watermark: str, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return _timed(df, ts, watermark).dropDuplicatesWithinWatermark(list(keys)).withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def breaker(df: DataFrame, key: str, ts: str, order: str, failed: Column, threshold: int) -> DataFrame:
    """For each key, as batches come in: failures in a row now, the longest run so far, and whether the breaker ever opened."""
    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, most = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "o"])  # one trigger's rows of one key
        for bad in rows["bad"]:
            now = now + 1 if bad else 0
            most = max(most, now)
        state.update((now, most))
        yield pd.DataFrame({"key": [keys[0]], "now": [now], "longest": [most], "opened": [most >= threshold]})

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("long").alias("o"), F.coalesce(failed, F.lit(False)).alias("bad"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, now int, longest int, opened boolean", "now int, longest int", "update", GroupStateTimeout.NoTimeout)


def alerts(df: DataFrame, limits: DataFrame, name: str, value: str) -> DataFrame:
    """A stream of metrics against a static table of limits."""
    from ..operators.monitor import alerts as batch_alerts

    return batch_alerts(df, limits, name, value)


def run_once(spark: SparkSession, stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all that is there into a Parquet folder and returns what it holds.

    Batches are written by their number, so one that is run again after a failure replaces itself.  In complete mode the
    last batch counts, in update mode the last row of each key.
    """
    folder = fresh(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{folder}/rows") if run.lastProgress else None
    if out is None:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*").select(*stream.columns)
    return out.drop("batch")
