"""Sections, chunks, definitions, graphs and chains: sources made from tables, with SQL over their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import sections as S
from .catalog import query, read, spread

# A source for each part: p_size % 5 + 1 paragraphs of p_size % 9 + 1 lines with ten tokens each; some have text before the first boundary.
_SOURCE = """concat(IF(p_size % 2 = 0, '* NOTE\n           X = Y\n', ''), '       PROCEDURE DIVISION.\n       MAIN-', p_partkey, ' SECTION.\n', array_join(transform(sequence(1, p_size % 5 + 1), i -> concat('       PARA-', i, '.\n', repeat('           DISPLAY ''A TEXT THAT FOLLOWS''.\n', p_size % 9 + 1))), ''))"""


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 2 = 0 AS head, p_size % 5 + 1 AS n, p_size % 9 + 1 AS m FROM part), o AS (SELECT *, CASE WHEN head THEN 2 ELSE 0 END AS up FROM p), i AS (SELECT *, unnest(range(1, n + 1)) AS i FROM o),
 c AS (SELECT *, unnest(range(1, CASE WHEN m * 10 + 3 <= 45 THEN 2 ELSE (m + 1 + 3) // 4 + 1 END)) AS c FROM i)
 SELECT k AS program, 'CHUNK' AS type, '' AS name, 1 AS part, 1 AS first, 2 AS last, 4::BIGINT AS n_tokens FROM o WHERE head
 UNION ALL SELECT k, 'DIVISION', 'PROCEDURE', 1, up + 1, up + 1, 6 FROM o UNION ALL SELECT k, 'SECTION', 'MAIN-' || k, 1, up + 2, up + 2, (length('       MAIN-' || k || ' SECTION.') // 4)::BIGINT FROM o
 UNION ALL SELECT k, 'PARAGRAPH', 'PARA-' || i, c::INTEGER, (up + 3 + (i - 1) * (m + 1) + CASE WHEN m * 10 + 3 <= 45 THEN 0 ELSE (c - 1) * 4 END)::INTEGER,
  (up + 3 + (i - 1) * (m + 1) + CASE WHEN m * 10 + 3 <= 45 THEN m + CASE WHEN i = n THEN 1 ELSE 0 END ELSE least(c * 4 - 1, m) + CASE WHEN i = n AND c * 4 > m AND (m + 1) % 4 <> 0 THEN 1 ELSE 0 END END)::INTEGER,
  (CASE WHEN m * 10 + 3 <= 45 THEN m * 10 + 3 ELSE (least(c * 4, m + 1) - (c - 1) * 4 - CASE WHEN c = 1 THEN 1 ELSE 0 END) * 10 + CASE WHEN c = 1 THEN 3 ELSE 0 END END)::BIGINT FROM c""")
def source_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of at most 45 tokens and four lines a part."""
    rows = spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("program"), F.expr(_SOURCE).alias("source"))
    return S.sections(rows, "program", "source", 45, 4)


@query("""SELECT doc_id, c::INTEGER AS chunk, (c - 1) * 3 + 1 AS first, least(c * 3, len(l)) AS last, md5(array_to_string(l[(c - 1) * 3 + 1 : c * 3], chr(10))) AS content FROM (SELECT doc_id, l, unnest(range(1, (len(l) + 2) // 3 + 1)) AS c FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
 WHERE trim(translate(array_to_string(l[(c - 1) * 3 + 1 : c * 3], ' '), chr(9) || chr(13), '  ')) <> ''""")
def generic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in chunks of three lines."""
    return S.fixed_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 3).withColumn("content", F.md5("content"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(list_transform(l, lambda x: length(x) // 4)) AS t FROM d),
 r AS (SELECT doc_id, i, t, 1 AS chunk, t AS total FROM l WHERE i = 1 UNION ALL SELECT l.doc_id, l.i, l.t, CASE WHEN r.total + l.t > 200 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.total + l.t > 200 THEN l.t ELSE r.total + l.t END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
 SELECT doc_id, chunk, min(i)::INTEGER AS first, max(i)::INTEGER AS last, sum(t)::BIGINT AS n_tokens FROM r GROUP BY doc_id, chunk""")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by lines within the budget of tokens."""
    return S.token_chunks(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT p_partkey AS program, 'REC-' || p_size AS field, 'definition' AS operation, 'group' AS data_type, 1 AS line FROM part UNION ALL SELECT p_partkey, 'FLD-' || p_partkey % 7, 'definition', CASE WHEN p_size % 2 = 0 THEN 'INTEGER' ELSE 'VARCHAR(' || p_size || ')' END, 2 FROM part""")
def definition_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('       01  REC-', p_size, '.\n           05  FLD-', p_partkey % 7, IF(p_size % 2 = 0, ' PIC 9(5).', concat(' PIC X(', p_size, ').')), '\n             88  IS-SET VALUE 1.\n           05  FILLER PIC X.')")
    rows = spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("program"), text.alias("source"))
    return S.definitions(X.data_items(X.facts(rows, "program", "source", X.only(X.COBOL, "data_item")), "program", parent=False), "program")


@query("""WITH p AS (SELECT l_suppkey AS s, l_partkey AS d, min(l_returnflag) AS r FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2), b AS (SELECT d AS component, 'upstream' AS side, s AS neighbour, r FROM p UNION ALL SELECT s, 'downstream', d, r FROM p),
 f AS (SELECT *, row_number() OVER (PARTITION BY component, side ORDER BY neighbour)::INTEGER AS rank, count(*) OVER (PARTITION BY component, side) AS n_side FROM b), g AS (SELECT * FROM f WHERE rank <= 5), h AS (SELECT *, count(*) OVER (PARTITION BY component) + 1 AS n_nodes FROM g)
 SELECT component, side, neighbour, r AS relationship, rank, n_side, n_nodes, CASE WHEN n_nodes > 10 THEN 'high' WHEN n_nodes > 5 THEN 'medium' ELSE 'low' END AS complexity FROM h""")
def cross_program_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.around(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("dependent"), F.col("l_returnflag").alias("relationship")))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'COMPLETE' ELSE 'PROCESSING' END AS stage FROM part""")
def component_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE p_size % 3 WHEN 0 THEN concat('identification division. END PROGRAM ', p_name) WHEN 1 THEN concat(p_name, ' End Program.') ELSE p_name END")
    return read(spark, sf_dir, "part").select("p_partkey", S.stage(text).alias("stage"))


@query("""SELECT l_partkey AS file, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag)::INTEGER AS position, l_orderkey AS program, l_returnflag AS operation, l_linenumber AS line FROM lineitem""")
def usage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.usage_chain(read(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", "l_returnflag", "l_linenumber")


@query("""WITH e AS (SELECT user_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS p, CASE WHEN event_id % 3 > 0 THEN 'r' || event_id % 5 END AS r, 'f' || event_id % 2 AS f FROM events)
 SELECT user_id, coalesce(string_agg(DISTINCT p, ',' ORDER BY p), '') AS transaction_patterns, coalesce(string_agg(DISTINCT r, ',' ORDER BY r), '') AS resource_types, string_agg(DISTINCT f, ',' ORDER BY f) AS business_functions, CASE WHEN count(DISTINCT p) > 3 THEN 'high' ELSE 'medium' END AS complexity FROM e GROUP BY user_id""")
def online_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("user_id", F.when(i % 4 > 0, F.col("event_type")).alias("p"), F.when(i % 3 > 0, F.concat(F.lit("r"), i % 5)).alias("r"), F.concat(F.lit("f"), i % 2).alias("f"))
    return S.merged_online(rows, "user_id", "p", "r", "f").withColumns({c: F.array_join(c, ",") for c in ("transaction_patterns", "resource_types", "business_functions")})


@query("SELECT event_id, event_type, value FROM events WHERE contains(lower(event_type), 'ur')")
def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_metrics(read(spark, sf_dir, "events"), "event_type", "UR").select("event_id", "event_type", "value")
