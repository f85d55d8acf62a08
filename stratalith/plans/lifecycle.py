"""Operations, stages, places and kinds of the made sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import extract as X
from ..operators import lifecycle as L
from .catalog import query, read
from .extract import BMS, COBOL, DB2, DDL, JCL, _cobol, _of, _rows, _texts, made

FILES = """OPEN """ + _of("INPUT,OUTPUT,I-O", "s % 3") + """ A-FILE
ADD 1 TO N{k % 3}
SUBTRACT {s} FROM M{k % 4}
""" + _of("READ A-FILE,WRITE A-REC INVALID KEY CONTINUE,REWRITE A-REC,DELETE A-FILE", "s % 4")


@query("""WITH p AS (SELECT p_partkey AS program, p_size AS s FROM part), o AS (SELECT program, ['READ', 'CREATE'][CAST(s % 3 AS INTEGER) + 1] AS operation FROM p WHERE s % 3 < 2 UNION ALL SELECT program, ['READ', 'CREATE', 'UPDATE', 'DELETE'][CAST(s % 4 AS INTEGER) + 1] FROM p)
 SELECT program, operation, CASE operation WHEN 'CREATE' THEN 'creation' WHEN 'READ' THEN 'read_operations' ELSE 'update_operations' END AS stage, count(*) AS n FROM o GROUP BY 1, 2""")
def lifecycle_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.file_operations(_texts(spark, sf_dir, FILES), "program", "text").withColumn("n", F.col("n").cast("long"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k AS program, 'N' || k % 3 AS field, 'UPDATE' AS operation, 1 AS n FROM p UNION ALL SELECT k, 'M' || k % 4, 'UPDATE', 1 FROM p""")
def field_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.field_operations(_texts(spark, sf_dir, FILES), "program", "text")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, 'FLD-' || p_partkey % 3 AS f FROM part) SELECT k AS program, field, operation, n FROM (SELECT k, f AS field, 'READ' AS operation, 2 AS n FROM p UNION ALL SELECT k, 'LAST-' || k % 6, 'WRITE', 1 FROM p UNION ALL SELECT k, 'SUM-' || s % 4, 'WRITE', 1 FROM p
 UNION ALL SELECT k, 'REC-' || k % 5, 'DEFINE', 1 FROM p UNION ALL SELECT k, f, 'DEFINE', 1 FROM p UNION ALL SELECT k, 'TXT-' || k % 4, 'DEFINE', 1 FROM p UNION ALL SELECT k, unnest(['TAB-A', 'CELL', 'ALT-B']), 'DEFINE', 1 FROM p)""")
def field_references_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.field_operations(_texts(spark, sf_dir, COBOL), "program", "text")


@query("SELECT p_partkey AS program, 15 AS line, 'WORKING-STORAGE' AS location, 'data_definition' AS usage_context FROM part")
def copy_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each COPY stands and what it is for."""
    return L.located(_texts(spark, sf_dir, COBOL), "program", "text", r"(?i)^\s*COPY\s")


@query("""SELECT p_partkey AS program, 'P' || p_partkey // 3 AS dependency, 'program' AS kind FROM part UNION ALL SELECT p_partkey, 'NOTHING' || p_partkey, 'program' FROM part UNION ALL SELECT p_partkey, unnest(['PROD.D' || p_partkey % 19 || '.DATA', 'PROD.O' || p_partkey % 23, 'PROD.LOG' || p_size % 4]), 'dataset' FROM part""")
def chunk_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs and data sets that chunks name; chunks keep their comments, so names in these count."""
    texts = _rows(spark, sf_dir).select(F.col("k").alias("program"), F.concat(made(COBOL), F.lit("\n"), made(JCL)).alias("text"))
    return L.dependencies(texts, "program", "text")


@query("""SELECT p_partkey AS program, 3 AS n_cics, 1 AS n_sql, 'LINK,RETURN' AS cics_commands, 'SELECT' AS sql_commands, 'T' || p_partkey % 9 AS tables, 1 AS n_reads, 0 AS n_writes, true AS returns FROM part""")
def online_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What CICS and DB2 statements of each program do."""
    out = L.online_facts(_cobol(spark, sf_dir, "cics", "sql"), "program")
    return out.select("program", "n_cics", "n_sql", *[F.array_join(c, ",").alias(c) for c in ("cics_commands", "sql_commands", "tables")], "n_reads", "n_writes", "returns")


@query("SELECT p_partkey AS program, unnest(['P' || p_partkey // 3, 'C' || p_partkey % 17, 'CPY' || p_partkey % 13]) AS dependency FROM part")
def dependency_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cobol(spark, sf_dir, *X.CALL_KINDS, "copy")
    return L.either_side(X.calls(found, "program"), X.copies(found, "program"))


@query("SELECT DISTINCT kind FROM (SELECT unnest(['LINK', 'RETURN', 'SELECT']) AS kind) WHERE kind <> 'SELECT' OR EXISTS (SELECT 1 FROM part)")
def common_pattern_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands that programs with odd and with even numbers have in common."""
    rows = _cobol(spark, sf_dir, "cics", "sql").select("program", F.col("a").alias("kind"))
    return L.common_kinds(rows, "program", "kind", F.col("program") % 2 == 1, F.col("program") % 2 == 0)


@query("""SELECT p_partkey AS program, ['PROGRAM', 'JOB', 'TABLE', 'UNKNOWN', 'MAP', 'COPYBOOK'][CAST(p_partkey % 6 AS INTEGER) + 1] AS type, ['COBOL', 'JCL', 'DB2', 'UNKNOWN', 'CICS', 'COBOL'][CAST(p_partkey % 6 AS INTEGER) + 1] AS subtype FROM part""")
def component_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of components by two patterns of one kind, or by their ending."""
    kind, text = F.col("k") % 6, F.lit("nothing")
    for n, template in enumerate((COBOL, JCL, DDL, DB2, BMS)):
        text = F.when(kind == n, made(template)).otherwise(text)
    rows = _rows(spark, sf_dir).select(F.col("k").alias("program"), text.alias("text"), F.when(kind == 5, "f.cpy").otherwise("f").alias("name"))
    return rows.select("program", S.component_kind(F.col("text"), F.col("name")).alias("c")).select("program", "c.*")


@query("""WITH q AS (SELECT conv_id, turn, lower(text) || CASE turn % 4 WHEN 1 THEN ' the commarea' WHEN 2 THEN ' db2 cursor' WHEN 3 THEN ' end to end' ELSE '' END AS q FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'cics|transaction|terminal|map|commarea') THEN 'cics_lifecycle' WHEN regexp_matches(q, 'db2|sql|database|table|query|cursor') THEN 'db2_lifecycle'
 WHEN regexp_matches(q, 'complete lifecycle|full lifecycle|system lifecycle|end to end') THEN 'complete_lifecycle' WHEN regexp_matches(q, 'analyze|analysis|what does|explain') THEN 'component_analysis' WHEN regexp_matches(q, 'lineage|trace|flow|where is|used by') THEN 'field_lineage'
 WHEN regexp_matches(q, 'lifecycle|created|updated|dependencies') THEN 'file_lifecycle' WHEN regexp_matches(q, 'find|search|show me|locate') THEN 'code_search' ELSE 'general' END AS intent FROM q""")
def chat_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.mapped(F.col("turn") % 4, {0: "", 1: " the commarea", 2: " db2 cursor", 3: " end to end"}, "")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.chat_intent(F.concat("text", asked)).alias("intent"))


@query("SELECT p_partkey, ['cobol', 'copybook', 'jcl', 'field', 'cobol', 'jcl'][CAST(p_size % 6 AS INTEGER) + 1] AS type FROM part")
def component_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = S.mapped(F.col("p_size") % 6, dict(enumerate(("CBL", "Copy", "proc", "variable", "thing", "JCL"))))
    return read(spark, sf_dir, "part").select("p_partkey", S.component_type(spelled).alias("type"))


@query("""WITH t AS (SELECT doc_id, length(text) AS n, replace(upper(text), ' THE ', ' PERFORM ') AS u, CASE doc_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 1000 ELSE 800 END AS easy, CASE doc_id % 3 WHEN 0 THEN 2000 WHEN 1 THEN 3000 ELSE 2500 END AS hard FROM (SELECT doc_id, replace(text, ' the ', ' perform ') AS text FROM documents)),
 c AS (SELECT *, (length(u) - length(replace(u, 'PERFORM', ''))) // 7 + (length(u) - length(replace(u, 'IF', ''))) // 2 + 2 * ((length(u) - length(replace(u, 'EVALUATE', ''))) // 8) + (length(u) - length(replace(u, 'EXEC SQL', ''))) // 8 + (length(u) - length(replace(u, 'EXEC CICS', ''))) // 9 AS points FROM t)
 SELECT doc_id, CASE WHEN n < easy AND points < 10 THEN 'low' WHEN n > hard OR points > 25 THEN 'high' ELSE 'medium' END AS effort FROM c""".replace("replace(upper(text), ' THE ', ' PERFORM ') AS u", "upper(text) AS u"))
def processing_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frequent word stands for PERFORM, which the texts lack."""
    kind = S.mapped(F.col("doc_id") % 3, {0: "db2_procedure", 1: "cics", 2: "cobol"})
    return read(spark, sf_dir, "documents").select("doc_id", S.effort(F.replace("text", F.lit(" the "), F.lit(" perform ")), kind).alias("effort"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'purchase' AND value > 20) AS b FROM events GROUP BY 1) SELECT user_id, CASE WHEN a + b = 0 THEN 'None' WHEN a + b <= 2 THEN 'Low' WHEN a + b <= 5 THEN 'Medium' ELSE 'High' END AS level,
 CASE WHEN a > 0 AND b > 0 THEN 'High - Bidirectional sync' WHEN a > 2 OR b > 2 THEN 'Medium - Multiple operations' WHEN a > 0 OR b > 0 THEN 'Low - Simple integration' ELSE 'None' END AS risk FROM c""")
def db2_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    c = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("a"), F.count_if((kind == "purchase") & (F.col("value") > 20)).alias("b"))
    return c.select("user_id", S.integration_level(F.col("a") + F.col("b")).alias("level"), S.exchange_risk(F.col("a"), F.col("b")).alias("risk"))


@query("""WITH n AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) SELECT event_type, event_id, ts FROM n WHERE k <= 1000""")
def metric_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thousand samples of each metric within a day (the length of the ring is the feature)."""
    return L.newest(read(spark, sf_dir, "events"), "event_type", "ts", "event_id", 1000, 24).select("event_type", "event_id", "ts")


@query("""WITH c AS (SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS unused, max(l_orderkey) - min(l_orderkey) AS lines, count(*) FILTER (l_linenumber = 7) AS divisions, count(*) FILTER (l_quantity > 45) > 0 AS storage FROM lineitem GROUP BY 1),
 r AS (SELECT l_suppkey, list_filter([CASE WHEN divisions > 5 THEN 'Consider breaking down large procedure divisions into smaller, focused modules' END, CASE WHEN NOT storage THEN 'No working storage section found - verify data definitions' END, CASE WHEN unused > 5 THEN 'Found ' || unused || ' potentially unused fields - consider cleanup' END,
  CASE WHEN lines > 1000 THEN 'Large component detected - consider modularization for better maintainability' END], lambda x: x IS NOT NULL) AS a FROM c)
 SELECT l_suppkey, CASE WHEN len(a) > 0 THEN array_to_string(a, ';') ELSE 'Component structure appears well-organized;Consider adding comprehensive error handling if not present;Ensure proper documentation for business logic sections' END AS advice FROM r""")
def component_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("unused"), (F.max("l_orderkey") - F.min("l_orderkey")).alias("lines"), F.count_if(F.col("l_linenumber") == 7).alias("divisions"), F.bool_or(F.col("l_quantity") > 45).alias("storage"))
    return c.select("l_suppkey", F.array_join(S.component_advice(F.col("divisions"), F.col("storage"), F.col("unused"), F.col("lines")), ";").alias("advice"))
