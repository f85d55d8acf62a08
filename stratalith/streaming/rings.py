"""Ring buffers as stream state: the newest values of each key, no older than a time before the newest.

Edge cases: rows older than the watermark are late and left out by Spark.  Of rows with equal times the greater order counts as
newer.  A key that gets nothing new for the retention time is forgotten by a timer.  Null keys are a key.  Null values count as rows without a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.keep import by_value

CAPACITY, HOURS = 1000, 24
SCHEMA = "key long, n int, oldest timestamp, newest timestamp, total double"


class Ring(StatefulProcessor):
    """Holds (time, order, value) of a key, the oldest first."""

    def __init__(self, capacity: int, hours: float):
        self.capacity, self.span = capacity, pd.Timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "ts timestamp, o long, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.ring.get()), columns=["ts", "o", "v"])
        new = [r[["ts", "o", "v"]] for r in rows]
        every = pd.concat([held, *new] if len(held) else new).sort_values(["ts", "o"], kind="stable")
        every = every[every["ts"] >= every["ts"].iloc[-1] - self.span].tail(self.capacity)
        self.ring.put([(t.to_pydatetime(), int(o), None if v is None or pd.isna(v) else float(v)) for t, o, v in every.itertuples(index=False)])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((every["ts"].iloc[-1] + self.span).timestamp() * 1000))
        yield pd.DataFrame({"key": [key[0]], "n": [len(every)], "oldest": [every["ts"].iloc[0]], "newest": [every["ts"].iloc[-1]], "total": [round(float(every["v"].astype("float64").sum()), 4)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield pd.DataFrame({"key": [key[0]], "n": [0], "oldest": [pd.NaT], "newest": [pd.NaT], "total": [0.0]})

    def close(self) -> None:
        pass


def _rows(df: DataFrame, key: str, ts: str, order: str, value: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("v")).where("ts is not null")


def ready(spark: SparkSession) -> None:
    """State of this kind needs the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ring(df: DataFrame, key: str, ts: str, order: str, value: str, capacity: int = CAPACITY, hours: float = HOURS, watermark: str = "1 hour") -> DataFrame:
    """A row for each key of a stream whenever its buffer changes: see SCHEMA; n 0 when it is forgotten."""
    ready(df.sparkSession)
    by_value(__name__)
    rows = _rows(df, key, ts, order, value).withWatermark("ts", watermark)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Ring(capacity, hours), outputStructType=SCHEMA, outputMode="Update", timeMode="EventTime")


def ring_of(df: DataFrame, key: str, ts: str, order: str, value: str, capacity: int = CAPACITY, hours: float = HOURS) -> DataFrame:
    """The buffers that a stream ends with if no row is late and none forgotten, from a batch."""
    rows = _rows(df, key, ts, order, value)
    by = Window.partitionBy("key")
    rows = rows.withColumns({"newest": F.max("ts").over(by), "at": F.row_number().over(by.orderBy(F.desc("ts"), F.desc("o")))}).where((F.col("ts") >= F.col("newest") - F.make_interval(secs=F.lit(int(hours * 3600)))) & (F.col("at") <= capacity))
    return rows.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("total"))
