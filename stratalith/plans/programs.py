"""Reports on programs, kinds of sources, metadata and lifecycles: sources made from tables, with SQL over their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import program as S
from ..operators import programs as P
from ..operators import relations as J
from .catalog import query, read, spread
from .program import each, items

# A program for each order in two overlapping sections; a line for each line item, by its part key.
_LINE = """CASE l_partkey % 7 WHEN 0 THEN concat('           COPY B', l_suppkey % 20, '.') WHEN 1 THEN concat('           call "P', l_partkey, '" USING A') WHEN 2 THEN concat('           EXEC CICS READ DATASET(''F', l_suppkey % 9, ''') END-EXEC')
 WHEN 3 THEN concat('           EXEC CICS XCTL PROGRAM(''P', l_partkey, ''') END-EXEC') WHEN 4 THEN concat('           EXEC SQL DELETE FROM T', l_suppkey % 5, ' END-EXEC') WHEN 5 THEN concat('           05 FLD-', l_suppkey % 11, ' PIC X(4).') ELSE concat('      * CALL "GONE"', l_partkey) END"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = items(spark, sf_dir, "l_partkey", "l_linenumber", "l_suppkey").select("program", each(_LINE).alias("lines"))
    half = F.greatest(F.lit(1), F.floor(F.size("lines") / 2)).cast("int")
    both = F.array(F.struct(F.lit(1).alias("first"), F.array_join("lines", "\n").alias("text")), F.struct(half.alias("first"), F.array_join(F.slice("lines", half, F.size("lines")), "\n").alias("text")))
    return whole.select("program", F.explode(both).alias("s")).select("program", "s.*")


_RELATIONS = """l AS (SELECT l_orderkey AS program, l_partkey AS k, l_suppkey AS s, l_partkey % 7 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS line FROM lineitem),
 r AS (SELECT program, k, s, line, ['copybook', 'call', 'cics_file', 'cics_program', 'sql', 'field'][kind + 1] AS category, ['COPY', 'CALL', 'CICS_READ', 'CICS_XCTL', 'SQL_DELETE', 'FIELD_DEFINITION'][kind + 1] AS type,
  CASE kind WHEN 0 THEN 'B' || s % 20 WHEN 2 THEN 'F' || s % 9 WHEN 4 THEN 'T' || s % 5 WHEN 5 THEN 'FLD-' || s % 11 ELSE 'P' || k END AS target, [0.9, 0.8, 0.7, 0.8, 0.8, 0.9][kind + 1]::DOUBLE AS confidence FROM l WHERE kind < 6)"""


@query(f"WITH {_RELATIONS} SELECT program, category, type, target, line::INTEGER AS line, confidence FROM r")
def section_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of both sections of each program, merged."""
    return P.merged_sections(P.line_relations(_sections(spark, sf_dir), "program", "text", "first"), "program")


@query(f"""WITH {_RELATIONS}, w AS (SELECT DISTINCT program, CASE WHEN category = 'copybook' THEN 'book' ELSE 'program' END AS kind, target AS name, CASE WHEN category = 'copybook' THEN s % 20 >= 15 ELSE k NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) END AS missing
  FROM r WHERE category IN ('copybook', 'call', 'cics_program')),
 n AS (SELECT program, coalesce(string_agg(CASE WHEN kind = 'book' THEN name END, ',' ORDER BY name), '') AS required_copybooks, coalesce(string_agg(CASE WHEN kind = 'program' THEN name END, ',' ORDER BY name), '') AS called_programs,
  coalesce(string_agg(CASE WHEN kind = 'book' AND missing THEN name END, ',' ORDER BY name), '') AS missing_copybooks, coalesce(string_agg(CASE WHEN kind = 'program' AND missing THEN name END, ',' ORDER BY name), '') AS missing_programs, bool_or(missing) AS has_missing FROM w GROUP BY program)
 SELECT c.*, coalesce(required_copybooks, '') AS required_copybooks, coalesce(called_programs, '') AS called_programs, coalesce(missing_copybooks, '') AS missing_copybooks, coalesce(missing_programs, '') AS missing_programs, coalesce(has_missing, false) AS has_missing
 FROM (SELECT program, count(*) FILTER (category = 'cics_file') AS n_cics_file, count(*) FILTER (category = 'cics_program') AS n_cics_program, count(*) FILTER (category = 'copybook') AS n_copybook, count(*) FILTER (category = 'call') AS n_call,
  count(*) FILTER (category = 'sql') AS n_sql, count(*) FILTER (category = 'field') AS n_field, round(avg(confidence), 4) AS confidence FROM r GROUP BY program) c LEFT JOIN n USING (program)""")
def program_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.merged_sections(P.line_relations(_sections(spark, sf_dir), "program", "text", "first"), "program")
    books = spark.range(15).select(F.concat(F.lit("b"), "id").alias("name"))
    programs = read(spark, sf_dir, "part").where("p_size <= 40").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    lists = ("required_copybooks", "called_programs", "missing_copybooks", "missing_programs")
    return P.program_report(found, "program", books, programs).withColumns({c: F.array_join(c, ",") for c in lists})


_SOURCE = """CASE p_partkey % 8 WHEN 0 THEN concat('PROCEDURE DIVISION.\n EXEC SQL CALL PR', p_size, ' END-EXEC\n', IF(p_size % 2 = 0, 'IF SQLCODE = 0', '')) WHEN 1 THEN concat('call "MQPUT1" using ', p_size) WHEN 2 THEN concat('MAP', p_size, ' DFHMSD TYPE=MAP')
 WHEN 3 THEN repeat('EXEC CICS SYNCPOINT\n', p_size % 10) WHEN 4 THEN concat('  //J', p_size, ' JOB') WHEN 5 THEN concat('01 REC-', p_size, ' PIC X.') WHEN 6 THEN concat('MQRC_', p_size, IF(p_size % 3 = 0, ' mqcc_OK', '')) ELSE concat('nothing ', p_size) END"""


@query("""SELECT p_partkey, p_partkey % 8 = 0 AND p_size % 2 = 0 AS stored_procedure, p_partkey % 8 = 1 OR (p_partkey % 8 = 6 AND p_size % 3 = 0) AS message_queue, p_partkey % 8 = 2 AS bms, p_partkey % 8 = 3 AND p_size % 10 > 5 AS heavy_cics,
 p_partkey % 8 = 4 AS jcl, p_partkey % 8 = 0 AS cobol, p_partkey % 8 = 5 OR (p_partkey % 8 = 7 AND p_size % 4 = 0) AS copybook FROM part""")
def source_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when((F.col("p_partkey") % 8 == 7) & (F.col("p_size") % 4 == 0), ".CPY")
    return read(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in P.kinds(F.expr(_SOURCE), suffix).items()))


@query("""SELECT l_orderkey, l_linenumber, 'F' || l_suppkey % 7 || ',TAB-' || l_partkey % 5 AS field_names, CASE WHEN l_partkey % 2 = 0 THEN 'CALL,MOVE' ELSE 'IF,READ' END AS operations, CASE WHEN l_partkey % 3 = 0 THEN 'LINK,RETURN' ELSE '' END AS cics_operations,
 CASE WHEN l_partkey % 3 = 1 THEN 'INSERT,SELECT' ELSE '' END AS db2_operations, CASE WHEN l_partkey % 3 = 1 THEN 'T' || l_suppkey % 9 || ',V1' ELSE '' END AS database_tables, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'READ' END AS file_operations FROM lineitem""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """concat('01 F', l_suppkey % 7, ' PIC X.\n  05 tab-', l_partkey % 5, ' PIC 9.\n', IF(l_partkey % 2 = 0, 'move A TO RE-READ-IT CALL X', 'IF A READ F'), '\n', CASE l_partkey % 3 WHEN 0 THEN 'EXEC CICS RETURN END-EXEC exec cics link END-EXEC'
      WHEN 1 THEN concat('EXEC SQL SELECT X FROM T', l_suppkey % 9, ' END-EXEC EXEC SQL INSERT INTO V1 END-EXEC') ELSE '' END)"""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *(F.array_join(c, ",").alias(n) for n, c in P.metadata(F.expr(text)).items()))


@query("""WITH c AS (SELECT l_orderkey AS p, l_partkey AS k, CASE l_suppkey % 5 WHEN 0 THEN 'creation' WHEN 1 THEN 'read' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' END AS s FROM lineitem)
 SELECT 'FILE-' || p_partkey AS name, count(DISTINCT p) AS programs, count(*) AS chunks, count(*) FILTER (s = 'creation') AS n_creation, count(*) FILTER (s = 'read') AS n_read, count(*) FILTER (s = 'update') AS n_update, count(*) FILTER (s = 'delete') AS n_delete
 FROM c JOIN part ON p_partkey = k GROUP BY 1""")
def data_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(element_at(array('open output', 'Select A, modify', 'update', 'purge', 'close'), cast(l_suppkey % 5 + 1 as int)), ' file_', l_partkey, ' XFILE-', l_partkey + 1)")
    chunks = read(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("chunk"), F.col("l_orderkey").alias("program"), text.alias("text"))
    return P.data_lifecycle(chunks, "program", "chunk", "text", read(spark, sf_dir, "part").select(F.concat(F.lit("FILE-"), "p_partkey").alias("name")))


@query("""WITH c AS (SELECT l_orderkey AS program, ['job_header', 'job_step', 'paragraph'][l_partkey % 3 + 1] AS kind, l_suppkey % 4 AS s FROM lineitem), k AS (SELECT program, kind, count(*) AS n FROM c GROUP BY 1, 2)
 SELECT c.program, count(*) AS chunks, max(kinds) AS kinds, count(*) FILTER (s IN (0, 1)) AS branching, count(*) FILTER (kind = 'job_step') AS steps, bool_or(s = 1) AS executes, bool_or(s = 2) AS defines_data
 FROM c JOIN (SELECT program, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1) USING (program) GROUP BY c.program""")
def structure_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = ("element_at(array({}), cast({} as int))".format(*x) for x in (("'job_header', 'job_step', 'paragraph'", "l_partkey % 3 + 1"), ("'go to x', 'exec pgm if', '//A DD *', 'move a to b'", "l_suppkey % 4 + 1")))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("program"), F.expr(kind).alias("kind"), F.expr(text).alias("text"))
    return P.structure_lifecycle(rows, "program", "kind", "text")


@query("""SELECT p_partkey AS program, 3 AS line, 'call' AS kind, 'PR' || p_size AS name, 'A,B-' || p_partkey % 7 AS parameters FROM part UNION ALL SELECT p_partkey, 5, 'locators', CASE WHEN p_size % 2 = 0 THEN 'PR' || p_size END, 'L1,L2' FROM part
 UNION ALL SELECT p_partkey, 7, 'cursor', 'C' || p_partkey % 5, 'L1' FROM part""")
def embedded_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """concat('       PROCEDURE DIVISION.\n       A-1.\n           EXEC SQL CALL PR', p_size, ' (:A,\n             :B-', p_partkey % 7, ') END-EXEC\n           EXEC SQL ASSOCIATE ', IF(p_size % 3 = 0, 'RESULT SET ', ''), 'LOCATORS (:L1, :L2)\n', IF(p_size % 2 = 0, concat('             WITH PROCEDURE PR', p_size), ''),
      ' END-EXEC EXEC SQL COMMIT END-EXEC\n           exec sql allocate C', p_partkey % 5, ' cursor for result set :L1 END-EXEC\n      * EXEC SQL CALL GONE END-EXEC\n           MOVE ''EXEC SQL CALL NO'' TO X.')"""
    sources = spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("program"), F.expr(text).alias("source"))
    return P.procedure_calls(S.statements(sources, "program", "source"), "program").withColumn("parameters", F.array_join("parameters", ","))


@query("SELECT s_suppkey, s_name, 0 AS line_number, 'UNKNOWN' AS call_type, false AS conditional_call, s_acctbal FROM supplier")
def adaptive_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted columns, with what stands for those that the table lacks."""
    return J.filled(read(spark, sf_dir, "supplier"), {"s_suppkey": None, "S_NAME": None, "line_number": 0, "call_type": "UNKNOWN", "conditional_call": False, "s_acctbal": None}).withColumnRenamed("S_NAME", "s_name")


@query("""WITH u AS (SELECT DISTINCT user_id AS c, event_type AS t FROM events), k AS (SELECT DISTINCT user_id AS a, (user_id * 7 + event_id) % 40 AS b FROM events WHERE event_id % 9 = 0),
 s AS (SELECT c, string_agg(t, ',' ORDER BY t) AS ts FROM u GROUP BY c), m AS (SELECT c, min(c) OVER (PARTITION BY ts) AS r, ts FROM s), h AS (SELECT DISTINCT x.r AS a, y.r AS b FROM u p JOIN u q ON p.t = q.t JOIN m x ON x.c = p.c JOIN m y ON y.c = q.c WHERE x.r < y.r)
 SELECT r AS a, c AS b, 'same_targets' AS kind FROM m WHERE c <> r UNION ALL SELECT a, b, 'shares' FROM h UNION ALL SELECT a, b, 'calls' FROM k WHERE a <> b AND b IN (SELECT user_id FROM events)""")
def related_by_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who shares targets with whom, and who calls whom."""
    events = read(spark, sf_dir, "events")
    calls = events.where("event_id % 9 = 0").select("user_id", ((F.col("user_id") * 7 + F.col("event_id")) % 40).alias("called"))
    return J.related(events, "user_id", "event_type", calls, "user_id", "called")
