"""Expansion of copybooks: sources and books made from tables, with SQL that builds the expanded text from keys alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import copybooks as C
from .catalog import query, read, spread

# Supplier k is a book that copies the book of k div 6 (0 is none), with its tag replaced; one in forty copies itself.
_BOOK = """concat('01  :TAG:-REC-', k, '.\n    05  X', k, '-:TAG: PIC X(', k % 9 + 1, ').\n    COPY S', IF(k % 40 = 7, k, k div 6), IF(k % 3 = 0, '', concat('\n      REPLACING ==:TAG:== BY\n  ==', IF(k % 3 = 1, ':TAG:', 'FIX'), '-', k, '==')), '.\n    05  PRE-END PIC 9.')"""
_SOURCE = """concat('       COPY S', p_partkey % 100 + 1, ' REPLACING ==:TAG:== BY ==P', p_partkey, '== LEADING ==PRE== BY ==POST== REC-1 BY REC-2.\n       MOVE :TAG: TO A.\n* COPY NOTHING\n', IF(p_size % 2 = 0, '       COPY NONE.', ''))"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.expr("s_suppkey as k")).select("name", F.expr(_BOOK).alias("text"))
    sources = spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("program"), F.expr(_SOURCE).alias("source"))
    return C.segments(sources, "program", "source", books)


# Books from the outermost in: tag is what :TAG: has become.
_LEVELS = """WITH RECURSIVE b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 40 = 7 THEN s_suppkey ELSE s_suppkey // 6 END AS inner_k FROM supplier),
 r AS (SELECT p_partkey AS program, p_size, p_partkey % 100 + 1 AS k, 0 AS depth, 'P' || p_partkey AS tag, NULL::BIGINT AS outer_k FROM part
  UNION ALL SELECT r.program, r.p_size, b.inner_k, depth + 1, CASE k3 WHEN 0 THEN r.tag WHEN 1 THEN r.tag || '-' || r.k ELSE 'FIX-' || r.k END, r.k FROM (SELECT *, k % 3 AS k3 FROM r) r JOIN b ON b.k = r.k WHERE r.k IS DISTINCT FROM r.outer_k),
 s AS (SELECT r.*, b.k IS NULL AS missing, coalesce(r.k = r.outer_k, false) AS cycle FROM r LEFT JOIN b ON b.k = r.k),
 t AS (SELECT *, CASE WHEN missing OR cycle THEN 'COPY S' || k || CASE WHEN depth = 0 THEN ' REPLACING ==:TAG:== BY ==P' || program || '== LEADING ==PRE== BY ==POST== REC-1 BY REC-2' WHEN outer_k % 3 = 0 THEN ''
   ELSE chr(10) || '      REPLACING ==:TAG:== BY' || chr(10) || '  ==' || CASE outer_k % 3 WHEN 1 THEN ':TAG:' ELSE 'FIX' END || '-' || outer_k || '==' END || '.'
  ELSE '01  ' || tag || '-REC-' || k || '.' || chr(10) || '    05  X' || k || '-' || tag || ' PIC X(' || k % 9 + 1 || ').' || chr(10) || '    ' END AS head,
  CASE WHEN missing OR cycle THEN '' ELSE chr(10) || '    05  POST-END PIC 9.' END AS tail FROM s)"""


@query(f"""{_LEVELS}
 SELECT program, '       ' || string_agg(head, '' ORDER BY depth) || string_agg(tail, '' ORDER BY depth DESC) || chr(10) || '       MOVE :TAG: TO A.' || chr(10) || '* COPY NOTHING' || chr(10) || CASE WHEN max(p_size) % 2 = 0 THEN '       COPY NONE.' ELSE '' END AS text,
  concat_ws(',', CASE WHEN max(p_size) % 2 = 0 THEN 'NONE' END, string_agg(CASE WHEN missing AND NOT cycle THEN 'S' || k END, ',')) AS missing, coalesce(string_agg(CASE WHEN cycle THEN 'S' || k END, ','), '') AS cycles FROM t GROUP BY program""")
def copy_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.expanded(_pieces(spark, sf_dir), "program").withColumns({c: F.array_join(c, ",") for c in ("missing", "cycles")})


@query(f"""{_LEVELS}, n AS (SELECT *, max(depth) OVER (PARTITION BY program) AS last, CASE WHEN missing OR cycle THEN length(head) - length(replace(head, chr(10), '')) ELSE 2 END AS ends FROM t),
 d AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY program ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above, sum(ends) OVER (PARTITION BY program)::BIGINT AS down FROM n),
 o AS (SELECT program, above + 1 AS line, 'S' || k AS book, 1 AS book_line, depth FROM d WHERE NOT (missing OR cycle) UNION ALL SELECT program, above + 2, 'S' || k, 2, depth FROM d WHERE NOT (missing OR cycle)
  UNION ALL SELECT program, above + i + 1, CASE WHEN depth > 0 THEN 'S' || outer_k END, (CASE WHEN depth > 0 THEN 3 ELSE 1 END + i)::INTEGER, depth FROM (SELECT *, unnest(range(0, ends + 1)) AS i FROM d WHERE missing OR cycle)
  UNION ALL SELECT program, down + last - depth + 1, 'S' || k, (CASE WHEN k % 3 = 0 THEN 4 ELSE 6 END), depth FROM d WHERE NOT (missing OR cycle)
  UNION ALL SELECT program, down + last + 1 + i, NULL, (i + 1)::INTEGER, -1 FROM (SELECT *, unnest(CASE WHEN p_size % 2 = 0 THEN [1, 2, 3] ELSE [1, 2] END) AS i FROM d WHERE depth = 0))
 SELECT program, line, arg_min(coalesce(book, ''), depth) AS book, arg_min(book_line, depth) AS book_line FROM o GROUP BY program, line""")
def copy_line_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_map(_pieces(spark, sf_dir), "program").withColumn("book", F.coalesce("book", F.lit("")))


@query("""WITH p AS (SELECT p_partkey AS program, p_size AS s FROM part),
 v AS (SELECT program, 5 AS place, 'variable' AS kind, 'A' || program AS value FROM p UNION ALL SELECT program, 5 + 4 + length('A' || program) + 4, 'numeric', s::VARCHAR FROM p
  UNION ALL SELECT program, 5 + 4 + length('A' || program) + 4 + 4 + length(s::VARCHAR) + s * 6, CASE WHEN s % 2 = 0 THEN 'pic' ELSE 'usage' END, CASE WHEN s % 2 = 0 THEN 'X(9)' ELSE 'COMP' END FROM p),
 g AS (SELECT *, sum(CASE WHEN place - before < 200 THEN 0 ELSE 1 END) OVER (PARTITION BY program ORDER BY place)::BIGINT AS "group" FROM (SELECT *, lag(place) OVER (PARTITION BY program ORDER BY place) AS before FROM v))
 SELECT program, "group", count(*) AS n, string_agg(kind, ',' ORDER BY kind) AS kinds, string_agg(value, ',' ORDER BY place) AS values, min(place) AS first, max(place) AS last FROM g GROUP BY program, "group" """)
def replacing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('COPY ==A', p_partkey, '== BY ==', p_size, '==', repeat('  AND ', p_size), IF(p_size % 2 = 0, '==PIC X(9)==', '==usage COMP=='))")
    rows = spread(read(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("program"), text.alias("source"))
    return C.replacing_groups(rows, "program", "source").withColumns({c: F.array_join(c, ",") for c in ("kinds", "values")})
