"""Merges, repairs, layouts, mentions, bucketed tables, indexes, catalogue and ring buffers over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import json_repair, layout, mentions, merge
from ..operators.keep import fresh
from ..sources import buckets, catalogue
from ..streaming import rings
from ..streaming.windows import run_once, stream_of
from .catalog import query, read, spread

# Each event as an analysis: numbers, texts, lists of either, and a key whose type changes from event to event.
_PROPS = """concat('{"k": ', get_json_object(props, '$.k'), ', "kind": "', event_type, '", "tags": ["', event_type, '", "u', user_id % 3, '"], "seen": [', event_id % 5, ', ', event_id % 7, '.5], "mixed": ',
  CASE event_id % 3 WHEN 0 THEN concat('"t', event_id % 4, '"') WHEN 1 THEN '{"a": [1, "b"]}' ELSE CAST(event_id % 9 AS STRING) END, ', "ok": ', event_id % 2 = 0, ', "none": []}')"""


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
 v AS (SELECT user_id, 'k' AS name, NULL AS s, k::DOUBLE AS d, event_id, 0 AS i, NULL AS j FROM e UNION ALL SELECT user_id, 'kind', event_type, NULL, event_id, 0, NULL FROM e
  UNION ALL SELECT user_id, 'tags', event_type, NULL, event_id, 0, NULL FROM e UNION ALL SELECT user_id, 'tags', 'u' || user_id % 3, NULL, event_id, 1, NULL FROM e
  UNION ALL SELECT user_id, 'seen', NULL, event_id % 5, event_id, 0, NULL FROM e UNION ALL SELECT user_id, 'seen', NULL, event_id % 7 + 0.5, event_id, 1, NULL FROM e UNION ALL SELECT user_id, 'ok', NULL, 1 - event_id % 2, event_id, 0, NULL FROM e
  UNION ALL SELECT user_id, 'mixed', CASE WHEN event_id % 3 = 0 THEN 't' || event_id % 4 END, CASE WHEN event_id % 3 = 2 THEN event_id % 9 END, event_id, 0,
    CASE event_id % 3 WHEN 0 THEN '"t' || event_id % 4 || '"' WHEN 1 THEN '{"a":[1,"b"]}' ELSE (event_id % 9)::VARCHAR END FROM e)
 SELECT user_id, name, CASE WHEN count(s) = count(*) THEN 'texts' WHEN count(d) = count(*) THEN 'mean' ELSE 'first' END AS rule, count(*) AS n,
  CASE WHEN count(s) = count(*) THEN string_agg(DISTINCT s, ',' ORDER BY s) END AS texts, CASE WHEN count(d) = count(*) THEN round(avg(d), 6) END AS mean,
  CASE WHEN count(s) < count(*) AND count(d) < count(*) THEN arg_min(j, event_id) END AS first FROM v GROUP BY user_id, name""")
def generic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_PROPS).alias("analysis"))
    return merge.merged(rows, "user_id", "analysis", ["event_id"]).withColumns({"texts": F.array_join("texts", ","), "mean": F.round("mean", 6)})


# Properties broken in ten ways; what comes back is what was meant.
_BROKEN = """CASE event_id % 10 WHEN 0 THEN concat('{"k": ', k, ', "user": "', event_type, '"') WHEN 1 THEN concat('Here it is: ```json\n{"k": ', k, ', "user": "', event_type, '"}\n``` as asked') WHEN 2 THEN concat('{k: ', k, ', user: ', event_type, '}')
  WHEN 3 THEN concat("{'k': ", k, ", 'user': '", event_type, "',}") WHEN 4 THEN concat('{"k" ', k, ' "user" "', event_type, '"}') WHEN 5 THEN concat('{{"k": ', k, ', "user": "', event_type, '"}}') WHEN 6 THEN concat('{"k": ', k, ', "user": "', event_type)
  WHEN 7 THEN concat('{"k": ', k, ',, "user": "', event_type, '"]}') WHEN 8 THEN concat('no object, ', k) ELSE concat('{"k": ', k, ', "user": "', event_type, '"}') END"""


@query("""SELECT event_id, CASE WHEN event_id % 10 <> 8 THEN CAST(props->>'$.k' AS BIGINT) ELSE -1 END AS k, CASE WHEN event_id % 10 <> 8 THEN event_type END AS user, CASE WHEN event_id % 10 <> 8 THEN 2 ELSE 0 END AS n_keys FROM events""")
def json_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).select("event_id", F.expr(_BROKEN).alias("broken"))
    found = json_repair.repair(rows, "broken")
    return found.select("event_id", F.coalesce(F.get_json_object("repaired", "$.k").cast("long"), F.lit(-1)).alias("k"), F.get_json_object("repaired", "$.user").alias("user"), F.coalesce(F.size(F.json_object_keys("repaired")), F.lit(0)).alias("n_keys"))


_LAYOUT = """concat('000100 01  REC-A.\n000200     05  HEAD.\n000300         10  KIND PIC X.\n000400         10  AMOUNT PIC S9(', p_size % 9 + 1, ')V99 ', IF(p_size % 2 = 0, 'COMP-3', 'COMP'), '.\n000500     05  TAB OCCURS ', p_size % 5 + 1, ' TIMES',
  IF(p_size % 3 = 0, ' DEPENDING ON KIND', ''), '.\n000600         10  CELL PIC X(', p_size, ').\n000700         10  RATE COMP-2.\n000800     05  ALT REDEFINES TAB.\n000900         10  WIDE PIC X(', p_size * 2, ').\n001000     05  LAST-PART PIC 9(3).')"""


@query("""WITH p AS (SELECT p_partkey AS program, p_size AS s, p_size % 5 + 1 AS o, CASE WHEN p_size % 2 = 0 THEN (p_size % 9 + 3) // 2 + 1 WHEN p_size % 9 + 3 <= 4 THEN 2 WHEN p_size % 9 + 3 <= 9 THEN 4 ELSE 8 END AS a FROM part),
 q AS (SELECT *, 1 + a AS tab, (s + 8) * o AS tabs, greatest((s + 8) * o, s * 2) AS wide FROM p),
 r AS (SELECT *, tab + tabs AS last FROM q)
 SELECT program, 'REC-A' AS name, NULL AS parent, 'HEAD,TAB,ALT,LAST-PART' AS children, 0 AS "offset", greatest(last + 3, tab + s * 2)::INTEGER AS bytes, 1 AS occurs, NULL AS depends_on FROM r
 UNION ALL SELECT program, 'HEAD', 'REC-A', 'KIND,AMOUNT', 0, (1 + a)::INTEGER, 1, NULL FROM r UNION ALL SELECT program, 'KIND', 'HEAD', '', 0, 1, 1, NULL FROM r UNION ALL SELECT program, 'AMOUNT', 'HEAD', '', 1, a::INTEGER, 1, NULL FROM r
 UNION ALL SELECT program, 'TAB', 'REC-A', 'CELL,RATE', tab::INTEGER, tabs::INTEGER, o::INTEGER, CASE WHEN s % 3 = 0 THEN 'KIND' END FROM r UNION ALL SELECT program, 'CELL', 'TAB', '', tab::INTEGER, s::INTEGER, 1, NULL FROM r
 UNION ALL SELECT program, 'RATE', 'TAB', '', (tab + s)::INTEGER, 8, 1, NULL FROM r UNION ALL SELECT program, 'ALT', 'REC-A', 'WIDE', tab::INTEGER, (s * 2)::INTEGER, 1, NULL FROM r
 UNION ALL SELECT program, 'WIDE', 'ALT', '', tab::INTEGER, (s * 2)::INTEGER, 1, NULL FROM r UNION ALL SELECT program, 'LAST-PART', 'REC-A', '', last::INTEGER, 3, 1, NULL FROM r""")
def layout_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("program"), F.expr(_LAYOUT).alias("source"))
    fields = layout.tree(X.data_items(X.facts(sources, "program", "source", X.only(X.COBOL, "data_item")), "program", parent=False), "program")
    return fields.select("program", "name", "parent", F.array_join("children", ",").alias("children"), "offset", "bytes", "occurs", "depends_on")


@query("""WITH c AS (SELECT l_partkey AS k, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT 'FILE_' || k AS name, l_orderkey AS program, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, l_orderkey)::INTEGER AS rank, count(*) OVER (PARTITION BY k) AS n_texts FROM c JOIN (SELECT p_partkey FROM part) ON p_partkey = k QUALIFY rank <= 20""")
def file_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts' files in the sources of all orders, written in five ways: the first twenty sources of each."""
    word = F.expr("element_at(array('READ FILE-%', 'open(file_%.dat)', 'x=File-%;', 'NOTFILE-% FILE-%', 'FILE-%X file-%'), cast(l_linenumber % 5 + 1 as int))")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.replace(word, F.lit("%"), F.col("l_partkey").cast("string")).alias("t"))
    sources = lines.groupBy(F.col("l_orderkey").alias("program")).agg(F.array_join(F.collect_list("t"), "\n").alias("source"))
    names = read(spark, sf_dir, "part").select(F.concat(F.lit("FILE_"), "p_partkey").alias("name"))
    return mentions.capped(mentions.mentions(sources, "program", "source", names, "name"), "program", 20).select("name", "program", "n", "rank", "n_texts")


@query("""WITH c AS (SELECT 'U' || user_id AS calling, event_type AS called, event_id % 10 AS line, ts, event_id, event_id % 3 AS batch FROM events),
 r AS (SELECT *, rank() OVER (PARTITION BY calling, called, line ORDER BY ts DESC, batch DESC) AS n FROM c)
 SELECT calling, called, line, event_id FROM r WHERE n = 1""")
def relation_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that come in three batches, the second one twice; each rewrites only the buckets of its keys."""
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("calling"), F.col("event_type").alias("called"), (F.col("event_id") % 10).alias("line"), "ts", "event_id")
    folder = fresh(spark, "relations")
    for batch in (0, 1, 1, 2):
        buckets.save_relation(rows.where(F.col("event_id") % 3 == batch), folder, "program_calls", "ts", 8)
    return buckets.table(spark, f"{folder}/program_calls").select("calling", "called", "line", "event_id")


@query("""WITH f AS (SELECT vec_id, vec_id // 10 AS file, label, CASE WHEN (vec_id // 10) % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings)
 SELECT file, vec_id, version, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM f JOIN embeddings USING (vec_id) WHERE file % 7 <> 0 AND (version = 1 OR vec_id % 2 = 0)""")
def index_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of files: all come in, every third file comes again with half of its vectors, every seventh is deleted; then the stream that brought them is run again."""
    path, state = fresh(spark, "index"), fresh(spark, "index-state")
    stream = stream_of(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("file"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(1).alias("version"))

    def update(batch: DataFrame) -> int:
        return buckets.update_index(batch, path, "file", "version", 8)

    buckets.follow(stream, update, state).awaitTermination()
    update(buckets.index(spark, path, "embedding").where("file % 3 = 0 and vec_id % 2 = 0").withColumn("version", F.lit(2)))
    update(buckets.index(spark, path, "embedding").where("file % 7 = 0").select("file").distinct().select("file", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(3).alias("version")))
    buckets.follow(stream, update, state + "-again").awaitTermination()
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return buckets.index(spark, path, "embedding").select("file", "vec_id", "version", F.round(total, 4).alias("total"))


def _catalogued(*tables: str) -> str:
    """SQL over the tables' own counts."""
    columns = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "customer": ("c_custkey", "c_name", "c_mktsegment"), "supplier": ("s_suppkey", "s_name")}
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, CASE WHEN typeof(any_value({c})) = 'VARCHAR' THEN NULL ELSE min({c})::DOUBLE END AS least FROM {t}" if c.endswith("key") or c.endswith("price")
                              else f"SELECT '{t}', '{c}', count(*), count(*) - count({c}), NULL FROM {t}" for t in tables for c in columns[t])


@query(_catalogued("orders", "customer", "supplier"))
def catalogue_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue.register(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("orders", "customer", "supplier")}, "catalogued")
    found = catalogue.scan(spark, "catalogued")
    some = F.col("column").isin("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "c_custkey", "c_name", "c_mktsegment", "s_suppkey", "s_name")
    return found.where(some).select("table", "column", "n_rows", "n_nulls", F.when(F.col("column").rlike("key$|price$"), F.col("least").cast("double")).alias("least"))


@query("""WITH m AS (SELECT user_id AS key, ts, event_id, value, max(ts) OVER (PARTITION BY user_id) AS newest, max(ts) OVER () AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
 SELECT key, CASE WHEN newest + INTERVAL 24 HOUR > now - INTERVAL 1 HOUR THEN count(*) ELSE 0 END::INTEGER AS n, CASE WHEN newest + INTERVAL 24 HOUR > now - INTERVAL 1 HOUR THEN min(ts) END AS oldest,
  CASE WHEN newest + INTERVAL 24 HOUR > now - INTERVAL 1 HOUR THEN newest END AS newest, CASE WHEN newest + INTERVAL 24 HOUR > now - INTERVAL 1 HOUR THEN round(sum(value), 4) ELSE 0 END AS total
 FROM m WHERE ts >= newest - INTERVAL 24 HOUR AND place <= 1000 GROUP BY key, newest, now""")
def stream_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring buffers of all users as the stream of events leaves them; those with nothing new for a day are empty."""
    out = run_once(spark, rings.ring(stream_of(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value"), "update", ("key",))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("oldest", "newest")})
