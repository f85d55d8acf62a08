"""Extraction queries over sources that are made from the rows of a table.

The data folders have no sources, so a program, a job, a procedure and so on is
written for each part, its names and clauses taken from the part's key and
size.  The SQL gives the facts from the same columns without reading any
source, so both sides are independent.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import extract as X
from ..operators import services as V
from .catalog import query, read, spread

def made(template: str) -> Column:
    """A text with the SQL expressions in braces put in."""
    parts = re.split(r"\{([^{}]*)\}", template)
    quoted = ["'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" if k % 2 == 0 else f"CAST({x} AS STRING)" for k, x in enumerate(parts)]
    return F.expr(f"concat({', '.join(quoted)})")


def _of(names: str, by: str) -> str:
    """One of the texts (with commas between; semicolons end their lines) by number, as an expression in braces."""
    return "{" + f"replace(split('{names}', ',')[CAST({by} AS INT)], ';', '\\n')" + "}"


COBOL = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. P{k}.
      * CALL 'NOTHING{k}'
       ENVIRONMENT DIVISION.
           SELECT F{k % 7}-FILE ASSIGN TO 'DD{k % 11}'.
       DATA DIVISION.
       FD  F{k % 7}-FILE.
       01  REC-{k % 5}.
           05  FLD-{k % 3}   PIC 9({s % 9 + 1}).
           05  TXT-{k % 4} PIC X({s}).
           05  TAB-A OCCURS {s % 5 + 1} TIMES.
               10  CELL PIC S9(7)V99 COMP-3.
           05  ALT-B REDEFINES TXT-{k % 4} PIC X(4).
       WORKING-STORAGE SECTION.
       COPY CPY{k % 13}.
       PROCEDURE DIVISION.
       MAIN-PART.
           OPEN """ + _of("INPUT,OUTPUT,I-O", "s % 3") + """ F{k % 7}-FILE
           PERFORM PART-{k % 2} UNTIL DONE
           CALL 'P{k div 3}' USING FLD-{k % 3} TXT-{k % 4}
           MOVE FLD-{k % 3} TO LAST-{k % 6}
           COMPUTE SUM-{s % 4} = SUM * 2
           IF FLD-{k % 3} > {s}
             EXEC CICS RETURN END-EXEC
             EXEC CICS LINK PROGRAM('C{k % 17}')
              COMMAREA(X) END-EXEC
           END-IF
           EXEC SQL SELECT A INTO :B FROM T{k % 9}
              WHERE C = 1 END-EXEC
      * EXEC SQL DELETE FROM GONE END-EXEC
           """ + _of("READ,WRITE", "s % 2") + """ F{k % 7}-FILE AT END CONTINUE
           CLOSE F{k % 7}-FILE
           EXEC CICS RETURN END-EXEC
           STOP RUN.
       PART-0.
           CONTINUE.
       PART-1.
           CONTINUE."""
JCL = """//J{k}  JOB (ACCT),'RUN',CLASS=A
//STEP1    EXEC PGM=P{k}
//IN1      DD DSN=PROD.D{k % 19}.DATA,DISP=SHR
//OUT1     DD DSN=PROD.O{k % 23},DISP=(""" + _of("NEW,MOD,OLD", "s % 3") + """,CATLG)
//STEP2    EXEC BACK{s % 3}
//LOG1     DD DSN=PROD.LOG{s % 4},DISP=MOD"""
DDL = """CREATE TABLE T{k} (ID INTEGER NOT NULL, TOTAL DECIMAL({s % 20 + 1},2),
  NOTE VARCHAR({s}), PRIMARY KEY (ID));
EXEC SQL DECLARE L{k % 8} TABLE ( LINE_ID CHAR(8) NOT NULL, QTY SMALLINT ) END-EXEC"""
MQ = "CALL '" + _of("MQCONN;MQOPEN;MQPUT;MQGET,MQPUT1,MQSUB;MQGET,MQBEGIN;MQPUT;MQCMIT,MQOPEN;MQPUT;MQCLOSE", "s % 5") + "' USING H"
DB2 = """CREATE PROCEDURE B{k} (IN X INT)
BEGIN
DECLARE N{s % 3} INTEGER;
DECLARE C{s % 4} CURSOR FOR SELECT A
 FROM T{k % 9};
DECLARE CONTINUE HANDLER FOR NOT FOUND
WHILE N > 0 DO
EXECUTE IMMEDIATE S{s % 2};
UPDATE T SET A = 1;
END"""
BMS = """SET{k % 30}   DFHMSD TYPE=MAP
MAP{k % 20}   DFHMDI SIZE=(24,80)
F{s}    DFHMDF POS=(3,10),LENGTH=8"""
VSAM = """EXEC CICS READ FILE('M{s}') INTO(REC)
 RIDFLD(K{k % 5}) RESP(R) END-EXEC
EXEC CICS REWRITE DATASET('M{s}') FROM(R{s % 3}) END-EXEC"""
LAYOUT = """01  REC-A.
  05 REC-TYPE PIC X.
  05 FILLER PIC X({s}).
  05 NN PIC 99.
    88 NN-NONE VALUE 0.
  05 FILLER PIC X.
""" + _of("""01  REC-B.;  05 BB PIC 9.;  05 FILLER PIC X.,  05 TT OCCURS 1 TO 9 TIMES DEPENDING ON NN.,  05 AA REDEFINES NN PIC X.;  05 AB REDEFINES NN PIC X.;  05 AC REDEFINES NN PIC X.,  51 ODD PIC X.""", "s % 4")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))


def _texts(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """A source for each part."""
    return _rows(spark, sf_dir).select(F.col("k").alias("program"), made(template).alias("text"))


def _cobol(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return X.facts(_texts(spark, sf_dir, COBOL), "program", "text", X.only(X.COBOL, *kinds))


@query("""SELECT p_partkey AS calling, 'P' || p_partkey // 3 AS called, 'COBOL_CALL' AS call_type, 20 AS line, 'FLD-' || p_partkey % 3 || ',TXT-' || p_partkey % 4 AS parameters, false AS conditional FROM part
 UNION ALL SELECT p_partkey, 'C' || p_partkey % 17, 'CICS_LINK', 25, NULL, true FROM part""")
def cobol_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.calls(_cobol(spark, sf_dir, *X.CALL_KINDS), "program").withColumn("parameters", F.array_join("parameters", ","))


@query("SELECT p_partkey AS calling, 'P' || p_partkey AS called, 'JCL_EXEC_PGM' AS call_type, 2 AS line FROM part UNION ALL SELECT p_partkey, 'BACK' || p_size % 3, 'JCL_EXEC_PROC', 5 FROM part")
def jcl_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.calls(X.facts(_texts(spark, sf_dir, JCL), "program", "text", X.JCL), "program").drop("parameters", "conditional")


@query("""SELECT p_partkey AS program, 'STEP1' AS step, 'IN1' AS dd, 'PROD.D' || p_partkey % 19 || '.DATA' AS dataset, 'READ' AS operation, 3 AS line FROM part
 UNION ALL SELECT p_partkey, 'STEP1', 'OUT1', 'PROD.O' || p_partkey % 23, ['CREATE', 'UPDATE', 'READ'][CAST(p_size % 3 AS INTEGER) + 1], 4 FROM part UNION ALL SELECT p_partkey, 'STEP2', 'LOG1', 'PROD.LOG' || p_size % 4, 'UPDATE', 6 FROM part""")
def jcl_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.datasets(X.facts(_texts(spark, sf_dir, JCL), "program", "text", X.JCL), "program")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k AS program, 8 AS line, 1 AS level, 'REC-' || k % 5 AS name, NULL AS picture, NULL AS sql_type, NULL AS parent, NULL AS redefines FROM p
 UNION ALL SELECT k, 9, 5, 'FLD-' || k % 3, '9(' || s % 9 + 1 || ')', 'INTEGER', 'REC-' || k % 5, NULL FROM p UNION ALL SELECT k, 10, 5, 'TXT-' || k % 4, 'X(' || s || ')', 'VARCHAR(' || s || ')', 'REC-' || k % 5, NULL FROM p
 UNION ALL SELECT k, 11, 5, 'TAB-A', NULL, NULL, 'REC-' || k % 5, NULL FROM p UNION ALL SELECT k, 12, 10, 'CELL', 'S9(7)V99', 'DECIMAL(9,2)', 'TAB-A', NULL FROM p UNION ALL SELECT k, 13, 5, 'ALT-B', 'X(4)', 'VARCHAR(4)', 'REC-' || k % 5, 'TXT-' || k % 4 FROM p""")
def copybook_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.data_items(_cobol(spark, sf_dir, "data_item"), "program").select("program", "line", "level", "name", "picture", "sql_type", "parent", "redefines")


@query("SELECT p_partkey AS program, 'TXT-' || p_partkey % 4 AS original, 'ALT-B' AS variants, 1 AS n FROM part")
def redefines_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.redefined(X.data_items(_cobol(spark, sf_dir, "data_item"), "program", parent=False), "program")


@query("""WITH f AS (SELECT 'FLD_' || p_partkey % 3 AS name, 'INTEGER' AS t, p_partkey AS k, p_size AS s FROM part UNION ALL SELECT 'TXT_' || p_partkey % 4, 'VARCHAR(' || p_size || ')', p_partkey, p_size FROM part UNION ALL SELECT 'CELL', 'DECIMAL(9,2)', p_partkey, p_size FROM part UNION ALL SELECT 'ALT_B', 'VARCHAR(4)', p_partkey, p_size FROM part),
 l AS (SELECT DISTINCT name, t FROM f), c AS (SELECT * FROM (VALUES ('CELL', 'DECIMAL(9,2)'), ('TXT_1', 'VARCHAR(10)'), ('OWNER', 'CHAR(8)')) c(name, t))
 SELECT coalesce(l.name, c.name) AS name, l.t AS layout_type, c.t AS table_type, CASE WHEN c.t IS NULL THEN 'layout_only' WHEN l.t IS NULL THEN 'table_only' WHEN l.t = c.t THEN 'match' ELSE 'type_differs' END AS state FROM l FULL JOIN c ON l.name = c.name""")
def layout_against_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of all layouts against the columns of a table."""
    fields = X.data_items(_cobol(spark, sf_dir, "data_item"), "program", parent=False).where("sql_type is not null").select("name", "sql_type").distinct()
    table = spark.createDataFrame([("cell", "DECIMAL(9,2)"), ("txt_1", "VARCHAR(10)"), ("owner", "CHAR(8)")], "name string, sql_type string")
    return V.layout_match(fields, table)


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 30 + 1 AS n, p_size % 6 AS v, p_size % 4 + 1 AS d FROM part), q AS (SELECT k, v, n, CASE v WHEN 0 THEN '9(' || n || ')' WHEN 1 THEN 'X(' || n || ')' WHEN 2 THEN 'S9(' || n || ')V' || repeat('9', d) WHEN 3 THEN repeat('X', n) WHEN 4 THEN 'S9(' || n || ')' ELSE '99V9(' || d || ')' END AS pic, d FROM p)
 SELECT k, pic, CASE WHEN v IN (1, 3) THEN 'VARCHAR(' || n || ')' WHEN v = 2 THEN 'DECIMAL(' || n + d || ',' || d || ')' WHEN v = 5 THEN 'DECIMAL(' || 2 + d || ',' || d || ')' WHEN n <= 9 THEN 'INTEGER' WHEN n <= 18 THEN 'BIGINT' ELSE 'DECIMAL(' || n || ',0)' END AS sql_type,
 CAST(CASE v WHEN 2 THEN n + d WHEN 5 THEN 2 + d ELSE n END AS INTEGER) AS length FROM q""")
def pic_to_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    pic = F.expr("""CASE s % 6 WHEN 0 THEN concat('9(', s % 30 + 1, ')') WHEN 1 THEN concat('X(', s % 30 + 1, ')') WHEN 2 THEN concat('S9(', s % 30 + 1, ')V', repeat('9', CAST(s % 4 + 1 AS INT))) WHEN 3 THEN repeat('X', CAST(s % 30 + 1 AS INT))
     WHEN 4 THEN concat('S9(', s % 30 + 1, ')') ELSE concat('99V9(', s % 4 + 1, ')') END""")
    pics = _rows(spark, sf_dir).select("k", pic.alias("pic"))
    return pics.select("k", "pic", N.pic_type(F.col("pic")).alias("sql_type"), N.pic_length(F.col("pic")).alias("length"))


@query("""SELECT p_partkey AS k, CASE p_size % 3 WHEN 2 THEN NULL WHEN 1 THEN 1 ELSE CAST(p_size AS INTEGER) END AS "min", CASE p_size % 3 WHEN 2 THEN NULL ELSE CAST(p_size AS INTEGER) END AS "max",
 CASE p_size % 3 WHEN 1 THEN 'N' || p_partkey % 5 END AS depending_on, CASE p_size % 3 WHEN 1 THEN 'IX' || p_partkey % 3 END AS indexed_by FROM part""")
def occurs_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("s") % 3 == 0, made("OCCURS {s} TIMES")).when(F.col("s") % 3 == 1, made("OCCURS 1 TO {s} TIMES\n  DEPENDING ON N{k % 5} INDEXED BY IX{k % 3}")).otherwise("PIC X")
    return _rows(spark, sf_dir).select("k", N.occurs(text).alias("o")).select("k", "o.*")


@query("""SELECT p_partkey AS program, 'T' || p_partkey AS "table", 0 AS "at", 'ID' AS "column", 'INTEGER' AS type, false AS nullable FROM part UNION ALL SELECT p_partkey, 'T' || p_partkey, 1, 'TOTAL', 'DECIMAL(' || p_size % 20 + 1 || ',2)', true FROM part
 UNION ALL SELECT p_partkey, 'T' || p_partkey, 2, 'NOTE', 'VARCHAR(' || p_size || ')', true FROM part UNION ALL SELECT p_partkey, 'L' || p_partkey % 8, 0, 'LINE_ID', 'CHAR(8)', false FROM part UNION ALL SELECT p_partkey, 'L' || p_partkey % 8, 1, 'QTY', 'SMALLINT', true FROM part""")
def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ddl_columns(_texts(spark, sf_dir, DDL), "program", "text")


@query("""SELECT p_partkey AS program, 'cics' AS kind, 'RETURN' AS command, unnest([24, 33]) AS line FROM part UNION ALL SELECT p_partkey, 'cics', 'LINK', 25 FROM part UNION ALL SELECT p_partkey, 'sql', 'SELECT', 28 FROM part""")
def embedded_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL and CICS statements, those that occur twice with a line each, none out of comments."""
    return _cobol(spark, sf_dir, "cics", "sql").select("program", "kind", F.col("a").alias("command"), "line")


@query("""WITH p AS (SELECT p_partkey AS k, 'F' || p_partkey % 7 || '-FILE' AS f, ['INPUT', 'OUTPUT', 'I-O'][CAST(p_size % 3 AS INTEGER) + 1] AS m, ['READ', 'WRITE'][CAST(p_size % 2 AS INTEGER) + 1] AS o FROM part)
 SELECT k AS program, f AS file, 'DD' || k % 11 AS physical, 'SELECT' AS access_type, NULL AS access_mode, 5 AS line FROM p UNION ALL SELECT k, f, NULL, 'FD', NULL, 7 FROM p UNION ALL SELECT k, f, NULL, 'OPEN', m, 18 FROM p
 UNION ALL SELECT k, f, NULL, o, m, 31 FROM p UNION ALL SELECT k, f, NULL, 'CLOSE', m, 32 FROM p""")
def file_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.file_access(_cobol(spark, sf_dir, *X.FILE_KINDS), "program")


@query("""WITH p AS (SELECT p_partkey AS k, 'FLD-' || p_partkey % 3 AS f FROM part) SELECT k AS program, 21 AS line, f AS field, 'READ' AS "use" FROM p UNION ALL SELECT k, 21, 'LAST-' || k % 6, 'WRITE' FROM p
 UNION ALL SELECT p_partkey, 22, 'SUM-' || p_size % 4, 'TRANSFORM' FROM part UNION ALL SELECT k, 23, f, 'VALIDATE' FROM p""")
def field_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.field_usage(_cobol(spark, sf_dir, *X.FIELD_KINDS), "program")


@query("SELECT p_partkey AS program, 'PART-' || 1 - p_partkey % 2 AS paragraph, CASE p_partkey % 2 WHEN 0 THEN 37 ELSE 35 END AS line FROM part")
def unreachable_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unreachable(_cobol(spark, sf_dir, *X.REACH_KINDS), "program")


@query("SELECT p_partkey AS program, 'CPY' || p_partkey % 13 AS copybook, 15 AS line FROM part")
def copy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.copies(_cobol(spark, sf_dir, "copy"), "program").select("program", "copybook", "line")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, 'FLD-' || p_partkey % 3 AS f FROM part)
 SELECT k AS program, 'OPEN,PERFORM,CALL,MOVE,COMPUTE,' || ['READ', 'WRITE'][CAST(s % 2 AS INTEGER) + 1] AS operations, 'IF ' || f || ' > ' || s AS decisions, 'MOVE ' || f || ' TO LAST-' || k % 6 || ';COMPUTE SUM-' || s % 4 || ' = SUM * 2' AS transformations, 'AT END' AS error_handling FROM p""")
def program_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations, decisions, transformations and error handling of each program, in order."""
    out = X.logic(_cobol(spark, sf_dir, *X.LOGIC_KINDS), "program")
    return out.select("program", F.array_join(F.array_remove("operations", "CLOSE"), ",").alias("operations"), F.array_join("decisions", ";").alias("decisions"), F.array_join("transformations", ";").alias("transformations"), F.array_join("error_handling", ",").alias("error_handling"))


@query("""SELECT p_partkey AS program, ['multi_record', 'conditional_layout', 'redefines_layout', 'single_record'][CAST(p_size % 4 AS INTEGER) + 1] AS kind, [8, 8, 11, 5][CAST(p_size % 4 AS INTEGER) + 1] AS complexity, CASE p_size % 4 WHEN 0 THEN 2 ELSE 1 END AS layout_indicators, 1 AS record_types,
 CASE p_size % 4 WHEN 2 THEN 3 ELSE 0 END AS redefines_count, CASE p_size % 4 WHEN 1 THEN 1 ELSE 0 END AS occurs_count, CASE p_size % 4 WHEN 1 THEN 1 ELSE 0 END AS conditional_fields FROM part""")
def layout_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of layout a copybook has, and how complex it is."""
    return _texts(spark, sf_dir, LAYOUT).select("program", X.layout_kind(F.col("text")).alias("l")).select("program", "l.*")


@query("""WITH p AS (SELECT p_partkey AS program, p_size % 4 AS v FROM part), f AS (SELECT program, v, unnest(['REC-TYPE', 'FILLER-1', 'NN', 'FILLER-2']) AS field, 'REC-A' AS record FROM p UNION ALL SELECT program, v, unnest(['BB', 'FILLER-1']), 'REC-B' FROM p WHERE v = 0
 UNION ALL SELECT program, v, 'TT', 'REC-A' FROM p WHERE v = 1 UNION ALL SELECT program, v, unnest(['AA', 'AB', 'AC']), 'REC-A' FROM p WHERE v = 2 UNION ALL SELECT program, v, 'ODD', 'REC-A' FROM p WHERE v = 3) SELECT program, record, field FROM f""")
def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each copybook with their fields, fillers numbered."""
    return X.records(X.data_items(X.facts(_texts(spark, sf_dir, LAYOUT), "program", "text", X.only(X.COBOL, "data_item")), "program", parent=False), "program").select("program", "record", "field")


@query("""WITH p AS (SELECT p_partkey AS program, p_size % 4 AS v FROM part) SELECT program, unnest(['REC-TYPE', 'FILLER', 'NN', 'NN-NONE', 'FILLER']) AS name, unnest([5, 5, 5, 88, 5]) AS level FROM p UNION ALL SELECT program, unnest(['BB', 'FILLER']), 5 FROM p WHERE v = 0
 UNION ALL SELECT program, 'TT', 5 FROM p WHERE v = 1 UNION ALL SELECT program, unnest(['AA', 'AB', 'AC']), 5 FROM p WHERE v = 2 UNION ALL SELECT program, 'ODD', 51 FROM p WHERE v = 3""")
def simple_layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and names alone."""
    return X.simple_fields(_texts(spark, sf_dir, LAYOUT), "program", "text").select("program", "name", "level")


@query("SELECT p_partkey AS program, 'ODD' AS name, 'INVALID_LEVEL_NUMBER' AS rule FROM part WHERE p_size % 4 = 3")
def level_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.level_violations(X.data_items(X.facts(_texts(spark, sf_dir, LAYOUT), "program", "text", X.only(X.COBOL, "data_item")), "program", parent=False), "program").select("program", "name", "rule")


@query("""WITH p AS (SELECT p_partkey AS program FROM part) SELECT program, unnest([0, 1, 2, 3]) AS chunk, unnest([0, 5, 13, 15]) AS first_line, unnest([5, 8, 2, 23]) AS n_lines, unnest(['division', 'division', 'section', 'division']) AS starts_with FROM p""")
def cobol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divisions and sections packed into chunks of 80 tokens, those that are longer alone."""
    return X.structured_chunks(_texts(spark, sf_dir, COBOL), "program", "text", "cobol", 80).select("program", "chunk", "first_line", F.col("n_lines").cast("int").alias("n_lines"), "starts_with")


@query("""WITH p AS (SELECT p_partkey AS program FROM part) SELECT program, unnest([0, 1, 2, 3, 4, 5]) AS chunk, unnest([0, 1, 2, 3, 4, 5]) AS first_line, unnest(['job_card', 'exec_step', 'dd_statement', 'dd_statement', 'exec_step', 'dd_statement']) AS starts_with FROM p""")
def jcl_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement a chunk of its own where the limit is one token."""
    return X.structured_chunks(_texts(spark, sf_dir, JCL), "program", "text", "jcl", 1).select("program", "chunk", "first_line", "starts_with")


@query("""SELECT p_partkey AS program, unnest([0, 1, 2, 3, 4]) AS chunk, unnest([0, 1, 3, 5, 6]) AS first_line, unnest(['create_procedure', 'begin_block', 'cursor_declare', 'handler_declare', 'while_loop']) AS starts_with FROM part""")
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.structured_chunks(_texts(spark, sf_dir, DB2), "program", "text", "sql", 1).select("program", "chunk", "first_line", "starts_with")


@query("""SELECT p_partkey AS program, 'jcl' AS language, 'missing_exec' AS rule FROM part WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'cobol', unnest(['missing_procedure', 'missing_program_id']) FROM part WHERE p_size % 4 = 1
 UNION ALL SELECT p_partkey, 'bms', 'missing_map' FROM part WHERE p_size % 4 = 2 UNION ALL SELECT p_partkey, 'cics', 'missing_return' FROM part WHERE p_size % 4 = 3""")
def validator_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken sources of four languages."""
    broken = (("jcl", "//J{k} JOB\n"), ("cobol", "IDENTIFICATION DIVISION.\n* P{k}"), ("bms", "X{k} DFHMSD TYPE=MAP"), ("cics", "EXEC CICS SEND MAP('M{k}') END-EXEC"))
    out = None
    for n, (language, template) in enumerate(broken):
        rows = _rows(spark, sf_dir).where(F.col("s") % 4 == n).select(F.col("k").alias("program"), made(template).alias("text"))
        one = X.violations(rows, "program", "text", language).withColumn("language", F.lit(language))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey AS program, ['request_reply', 'fire_and_forget', 'publish_subscribe', 'transactional', 'persistent'][CAST(p_size % 5 AS INTEGER) + 1] AS flow FROM part")
def mq_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.message_flow(X.facts(_texts(spark, sf_dir, MQ), "program", "text", X.MQ), "program").drop("calls")


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k AS program, 'procedure' AS kind, 'B' || k AS a, '(IN X INT)' AS b FROM p UNION ALL SELECT k, 'declare', 'N' || s % 3, 'INTEGER' FROM p UNION ALL SELECT k, 'cursor', 'C' || s % 4, 'SELECT A' || chr(10) || ' FROM T' || k % 9 FROM p
 UNION ALL SELECT k, 'handler', 'CONTINUE', 'NOT FOUND' FROM p UNION ALL SELECT k, 'db2_control', 'WHILE', NULL FROM p UNION ALL SELECT k, 'dynamic_sql', 'EXECUTE IMMEDIATE', 'S' || s % 2 FROM p UNION ALL SELECT k, 'statement', 'UPDATE', NULL FROM p""")
def db2_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.facts(_texts(spark, sf_dir, DB2), "program", "text", X.DB2).select("program", "kind", "a", "b")


@query("SELECT p_partkey AS program, 'mapset' AS kind, 'SET' || p_partkey % 30 AS name FROM part UNION ALL SELECT p_partkey, 'map', 'MAP' || p_partkey % 20 FROM part UNION ALL SELECT p_partkey, 'field', 'F' || p_size FROM part")
def bms_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.facts(_texts(spark, sf_dir, BMS), "program", "text", X.BMS).select("program", "kind", F.col("a").alias("name"))


@query("SELECT p_partkey AS program, ['cobol', 'jcl', 'mq_program', 'db2_procedure', 'bms', 'copybook', 'unknown'][CAST(p_partkey % 7 AS INTEGER) + 1] AS kind FROM part WHERE p_partkey % 7 <> 2 OR p_size % 5 NOT IN (2, 3) UNION ALL SELECT p_partkey, 'unknown' FROM part WHERE p_partkey % 7 = 2 AND p_size % 5 IN (2, 3)")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("k") % 7
    text = F.lit("nothing")
    for n, template in enumerate((COBOL, JCL, MQ, DB2, BMS)):
        text = F.when(kind == n, made(template)).otherwise(text)
    rows = _rows(spark, sf_dir).select(F.col("k").alias("program"), text.alias("text"), F.when(kind == 5, "f.cpy").otherwise("f").alias("name"))
    return rows.select("program", X.source_kind(F.col("text"), F.col("name")).alias("kind"))


@query("""SELECT p_partkey AS program, 'READ' AS command, 'M' || p_size AS file, 'K' || p_partkey % 5 AS ridfld, 'REC' AS into_area, NULL AS from_area FROM part UNION ALL SELECT p_partkey, 'REWRITE', 'M' || p_size, NULL, NULL, 'R' || p_size % 3 FROM part""")
def vsam_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of CICS file commands."""
    found = X.facts(_texts(spark, sf_dir, VSAM), "program", "text", X.only(X.COBOL, "cics"))

    def option(names: str) -> Column:
        return F.nullif(F.regexp_extract("b", rf"(?i)\b(?:{names})\s*\(\s*'?([A-Za-z0-9-]+)", 1), F.lit(""))

    return found.select("program", F.col("a").alias("command"), option("FILE|DATASET").alias("file"), option("RIDFLD").alias("ridfld"), option("INTO").alias("into_area"), option("FROM").alias("from_area"))


@query("SELECT doc_id, CASE WHEN regexp_matches(upper(text), 'CREATE\\s+TABLE') THEN 'ddl' WHEN contains(upper(text), 'DECLARE') AND contains(upper(text), 'TABLE') THEN 'dclgen' WHEN contains(text, ',') AND contains(text, chr(10)) THEN 'csv' ELSE 'unknown' END AS kind FROM documents")
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.content_kind(F.col("text")).alias("kind"))


_COUNTS = "list_transform(list_slice(string_split(text, chr(10)), 1, 5), lambda x: length(x) - length(replace(x, {m}, '')))"
_TOTAL = ", ".join(f"CASE WHEN len(list_distinct({_COUNTS.format(m=m)})) <= 2 THEN list_sum({_COUNTS.format(m=m)}) ELSE 0 END AS {n}" for m, n in (("','", "a"), ("'|'", "b"), ("chr(9)", "c"), ("';'", "d"), ("':'", "e")))


@query(f"WITH t AS (SELECT doc_id, {_TOTAL} FROM documents), m AS (SELECT *, greatest(a, b, c, d, e) AS most FROM t) SELECT doc_id, CASE WHEN most = 0 THEN ',' WHEN a = most THEN ',' WHEN b = most THEN '|' WHEN c = most THEN chr(9) WHEN d = most THEN ';' ELSE ':' END AS delimiter FROM m")
def detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.delimiter(F.col("text")).alias("delimiter"))
