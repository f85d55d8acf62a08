"""Windows over time, alerts, breakers and caches; the streams of ``streaming`` give the same over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitor as M
from ..streaming import windows as W
from .catalog import query, read

_LIMITS = [("click", 60.0, 90.0), ("view", 70.0, 95.0), ("purchase", 50.0, 80.0)]
_ALERTS = "a AS (SELECT event_id, event_type, user_id, ts, value, CASE WHEN value >= c THEN 'critical' WHEN value >= w THEN 'warning' END AS severity FROM events JOIN (VALUES ('click', 60.0, 90.0), ('view', 70.0, 95.0), ('purchase', 50.0, 80.0)) l(m, w, c) ON m = event_type)"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(_LIMITS, "metric string, warning double, critical double")
    return M.alerts(read(spark, sf_dir, "events"), limits, "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", "event_type", "value")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - s * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1), (2), (3)) v(s) GROUP BY 1, 2""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding(read(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes", "event_type", "value")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(read(spark, sf_dir, "events"), "ts", "30 minutes", "user_id")


@query(f"WITH {_ALERTS} SELECT event_id, event_type, value, severity FROM a WHERE severity IS NOT NULL")
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select("event_id", "event_type", "value", "severity")


@query(f"WITH {_ALERTS} SELECT user_id, CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END AS status, count(severity) AS n_alerts FROM a WHERE severity IS NOT NULL GROUP BY 1")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.overall(_alerts(spark, sf_dir), "user_id")


@query("SELECT event_id, user_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up of old rows leaves."""
    from ..operators.reports import since

    return since(read(spark, sf_dir, "events"), "ts", "7 days").select("event_id", "user_id", "ts")


@query("SELECT user_id, event_id, round(row_number() OVER w * 100.0::DOUBLE / count(*) OVER (PARTITION BY user_id), 2) AS progress_pct FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.row_number().over(w.orderBy("ts", "event_id")) * 100.0 / F.count("*").over(w), 2).alias("progress_pct"))


@query("""WITH f AS (SELECT user_id, event_id, ts, (value > 40) AS bad FROM events), r AS (SELECT *, sum(CASE WHEN NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM f),
 n AS (SELECT *, CAST(sum(bad::INT) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS BIGINT) AS failures_in_row FROM r) SELECT user_id, event_id, failures_in_row, failures_in_row >= 3 AS open FROM n""")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.breaker_states(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 40, 3)
    return out.select("user_id", "event_id", "failures_in_row", "open")


@query("SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS s_suppkey FROM supplier GROUP BY 1")
def least_loaded_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.least_loaded(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")


@query("""WITH l AS (SELECT user_id, max(ts) AS last_use, count(*) AS n FROM events GROUP BY 1), x AS (SELECT *, last_use <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS expired FROM l),
 k AS (SELECT *, row_number() OVER (PARTITION BY expired ORDER BY last_use DESC, user_id) AS r FROM x) SELECT user_id, last_use, n, expired, NOT expired AND r > 50 AS evicted FROM k""")
def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cache_state(read(spark, sf_dir, "events"), "user_id", "ts", "1 day", 50)


@query("SELECT event_type, round(count(*) / 60.0::DOUBLE, 6) AS rps, time_bucket(INTERVAL 60 SECOND, ts) AS start FROM events GROUP BY 1, 3")
def requests_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.tumbling(read(spark, sf_dir, "events"), "ts", "60 seconds", "event_type", "value")
    return w.select("event_type", F.round(F.col("n") / 60.0, 6).alias("rps"), "start")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tumbling_window over the events as a stream, run until the folder is read."""
    return W.run_once(spark, W.tumbling(W.stream_of(spark, sf_dir, "events"), "ts", "1 hour", "event_type", "value", watermark="1 hour"), "complete")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, as a stream with a watermark."""
    return W.run_once(spark, W.distinct(W.stream_of(spark, sf_dir, "events"), "ts", "365 days", "event_id").select("event_id", "user_id", "ts"), "append")


def stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of failures of each user and whether its breaker ever opened, kept as state."""
    return W.run_once(spark, W.breaker(W.stream_of(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("value") > 40, 3), "update", ("key",))


query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(stream_tumbling)
query("SELECT event_id, user_id, ts FROM events")(stream_dedupe)
query()(stream_breaker)
