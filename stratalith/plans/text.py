"""Scores, classes, names and chunks of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scoring as S
from ..operators import chunks as C
from .catalog import query, read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def _words(text: str, *words: str) -> str:
    return f"len(regexp_extract_all(' ' || regexp_replace(upper({text}), '[^A-Z0-9_]', '  ', 'g') || ' ', ' ({'|'.join(words)}) '))"


_DECISIONS = _words("text", "IF", "WHEN", "PERFORM", "UNTIL", "WHILE", "CASE", "THE", "DE")


@query(f"""SELECT doc_id, CAST(least(10.0, 1 + {_words("t", "IF", "WHEN", "PERFORM", "UNTIL", "WHILE", "CASE")} + 0.5 * len(list_filter(string_split(t, chr(10)), lambda x: {_words("x", "IF", "PERFORM")} > 0))) AS DOUBLE) AS complexity
 FROM (SELECT doc_id, replace(replace(text, ' the ', ' if '), ' la ', ' perform ') AS t FROM documents)""")
def complexity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frequent words stand for IF and PERFORM, which the texts lack."""
    text = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" if ")), F.lit(" la "), F.lit(" perform "))
    return _docs(spark, sf_dir).select("doc_id", S.complexity(text).alias("complexity"))


_SQLS = ["SELECT a FROM t", "SELECT a FROM t INNER JOIN u ON t.k = u.k WHERE a > (SELECT max(b) FROM v) GROUP BY a ORDER BY a", "UPDATE t SET a = 1", "WITH x AS (SELECT 1) SELECT sum(a) OVER (PARTITION BY b) FROM t LEFT JOIN x ON 1 = 1 FULL JOIN y ON 2 = 2"]


@query("SELECT unnest([0, 1, 2, 3]) AS id, unnest([1, 10, 2, 18]) AS complexity")
def sql_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_SQLS)), "id int, sql string").select("id", S.sql_complexity(F.col("sql")).alias("complexity"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents), c AS (SELECT doc_id, len(s) AS n, len(list_filter(s, lambda x: trim(x) = '')) AS e, len(list_filter(s, lambda x: x LIKE 'L%')) AS k FROM l)
 SELECT doc_id, CAST(n AS INTEGER) AS n_lines, round(e::DOUBLE / n, 4) AS empty_ratio, round(k::DOUBLE / n, 4) AS comment_ratio, round((n - e - k)::DOUBLE / n, 4) AS code_ratio FROM c""")
def code_line_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with L stand for comments."""
    return C.line_ratios(_docs(spark, sf_dir), "doc_id", "text", lambda x: x.startswith("L"))


@query("""WITH s AS (SELECT o_custkey, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 9.0 ELSE o_orderkey % 7 END) AS m, var_pop(o_orderkey % 7) AS v, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS r FROM orders GROUP BY 1)
 SELECT o_custkey, round(greatest(0.0, least(10.0, 5.0 + CASE WHEN r > 0.1 THEN least(2.0, 5 * r) ELSE 0.0 END - CASE WHEN m > 5 THEN least(3.0, 0.5 * (m - 5)) ELSE 0.0 END + CASE WHEN v < 2 THEN 1.0 ELSE 0.0 END)), 4) AS quality,
 round(greatest(0.0, least(10.0, 8 - 0.5 * greatest(0.0, m - 3) + 2 * r)), 4) AS maintainability FROM s""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderpriority") == "1-URGENT", 9.0).otherwise(F.col("o_orderkey") % 7)
    s = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg(value).alias("m"), S.variance(F.col("o_orderkey") % 7).alias("v"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("r"))
    return s.select("o_custkey", F.round(S.code_quality(F.col("r"), F.col("m"), F.col("v")), 4).alias("quality"), F.round(S.maintainability(F.col("m"), F.col("r")), 4).alias("maintainability"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) FILTER (contains(lower(x), ' the ')) AS n_if, count(*) FILTER (NOT contains(lower(x), ' the ') AND contains(lower(x), ' de ')) AS n_perform,
 count(*) FILTER (NOT contains(lower(x), ' the ') AND NOT contains(lower(x), ' de ') AND trim(x) <> '') AS n_other FROM l GROUP BY 1""")
def control_flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line counts for the first kind that it shows."""
    return C.line_kinds(_docs(spark, sf_dir), "doc_id", "text", [("n_if", lambda x: F.contains(F.lower(x), F.lit(" the "))), ("n_perform", lambda x: F.contains(F.lower(x), F.lit(" de "))), ("n_other", lambda x: F.trim(x) != "")])


@query(r"""WITH t AS (SELECT doc_id, text AS t, upper(text) AS u, length(text) AS n FROM documents),
 c AS (SELECT *, (SELECT count(*) FROM (VALUES ('{'), ('}'), ('('), (')'), ('['), (']'), (';'), ('FUNCTION'), ('CLASS'), ('DEF'), ('IF'), ('ELSE'), ('FOR'), ('WHILE'), ('IDENTIFICATION DIVISION'), ('PROCEDURE DIVISION'), ('DATA DIVISION'),
  ('EXEC CICS'), ('EXEC SQL'), ('PERFORM'), ('MOVE'), ('CALL'), ('//'), ('EXEC'), ('DD'), ('JOB'), ('STEP')) w(w) WHERE contains(u, w)) AS code,
  (SELECT count(*) FROM (VALUES ('{"'), ('"}'), ('":'), ('",'), ('[{'), ('}]'), ('<'), ('>'), ('<?xml'), ('</'), ('/>'), ('<!--'), ('PIC '), ('OCCURS '), ('REDEFINES '), ('01 '), ('05 ')) w(w) WHERE contains(t, w)) AS structured,
  len(regexp_extract_all(t, '[^\s\x0B\x1C-\x1F\x85\pZ]+')) AS words, len(regexp_extract_all(t, '[\pL\pN]')) AS letters, len(regexp_extract_all(t, '[^\pL\pN\s\x0B\x1C-\x1F\x85\pZ]')) AS marks,
  (SELECT sum((n - length(replace(t, w, ''))) // length(w)) FROM (VALUES ('=='), ('!='), ('<='), ('>='), ('->'), ('=>'), ('++'), ('--'), ('&&'), ('||'), ('**'), ('//'), ('/*'), ('*/'), ('<!--'), ('-->')) w(w)) AS operators,
  n - length(replace(t, chr(10), '')) AS line_ends FROM t),
 e AS (SELECT doc_id, n, n / CASE WHEN code >= 3 THEN 3.2::DOUBLE WHEN structured >= 2 THEN 3.8::DOUBLE ELSE 4.2::DOUBLE END + CASE WHEN marks / n > 0.1 THEN marks * 0.3::DOUBLE ELSE 0 END
  + CASE WHEN words > 0 AND letters / words < 4 THEN words * 0.1::DOUBLE ELSE 0 END + line_ends * 0.5::DOUBLE + operators * 0.5::DOUBLE AS x FROM c)
 SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, n // 10, least(floor(x), n)) END AS BIGINT) AS tokens, CAST(n // 4 AS BIGINT) AS simple_tokens FROM e""".replace("\\\\", "\\"))
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", S.estimated_tokens(F.col("text")).alias("tokens"), F.floor(F.length("text") / 4).alias("simple_tokens"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(0, CASE WHEN len(ws) <= 1500 THEN 0 ELSE CAST(ceil((len(ws) - 1500) / 1300.0) AS BIGINT) END))) AS k FROM w)
 SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(len(list_slice(ws, k * 1300 + 1, k * 1300 + 1500)) AS INTEGER) AS n_words, md5(array_to_string(list_slice(ws, k * 1300 + 1, k * 1300 + 1500), ' ')) AS digest FROM s""")
def chunk_words_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1500 words, 200 of them shared with the next."""
    out = C.word_windows(_docs(spark, sf_dir), "doc_id", "text", 1500, 200)
    return out.select("doc_id", "chunk", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("digest"))


@query("""WITH n AS (SELECT p_partkey, CASE p_size % 12 WHEN 0 THEN 'CUST-' WHEN 1 THEN 'ACCT-' WHEN 2 THEN 'TXN-' WHEN 3 THEN 'ORDER-AMT-' WHEN 4 THEN 'SVC-' WHEN 5 THEN 'BRANCH-' WHEN 6 THEN 'FLAG-' WHEN 7 THEN 'ZIP-' ELSE 'X' END || upper(p_name) AS n FROM part)
 SELECT p_partkey, CASE WHEN regexp_matches(n, 'AMOUNT|AMT|BALANCE|BAL|RATE|FEE|COST|PRICE') THEN 'financial' WHEN regexp_matches(n, 'DATE|TIME|TIMESTAMP|DT|TM|YEAR|MONTH|DAY') THEN 'temporal' WHEN regexp_matches(n, 'CUSTOMER|CUST|CLIENT|NAME|ADDR|ADDRESS|PHONE|EMAIL') THEN 'customer'
  WHEN regexp_matches(n, 'ACCOUNT|ACCT|ACC|NUMBER|NUM|ID|IDENTIFIER') THEN 'account' WHEN regexp_matches(n, 'TRANS|TXN|TRANSACTION|PAYMENT|TRANSFER') THEN 'transaction' WHEN regexp_matches(n, 'STATUS|STAT|FLAG|IND|INDICATOR|CODE|TYPE') THEN 'control'
  WHEN regexp_matches(n, 'PRODUCT|PROD|ITEM|SERVICE|SVC') THEN 'product' WHEN regexp_matches(n, 'BRANCH|LOCATION|LOC|REGION|AREA|ZONE') THEN 'location' ELSE 'general' END AS domain,
  CASE WHEN regexp_matches(n, 'CUST|CUSTOMER|CLIENT') THEN 'CUSTOMER' WHEN regexp_matches(n, 'AMT|AMOUNT|BAL|BALANCE|RATE|FEE') THEN 'FINANCIAL' WHEN regexp_matches(n, 'ACCT|ACCOUNT|ACC') THEN 'ACCOUNT' WHEN regexp_matches(n, 'DATE|TIME|TIMESTAMP|DT') THEN 'TEMPORAL'
  WHEN regexp_matches(n, 'TXN|TRANS|TRANSACTION') THEN 'TRANSACTION' WHEN regexp_matches(n, 'ADDR|ADDRESS|STREET|CITY|STATE|ZIP') THEN 'ADDRESS' ELSE 'GENERAL' END AS report_domain FROM n""")
def business_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for fields; a head by size makes names of every domain."""
    head = S.mapped(F.col("p_size") % 12, dict(enumerate(("CUST-", "ACCT-", "TXN-", "ORDER-AMT-", "SVC-", "BRANCH-", "FLAG-", "ZIP-"))), "X")
    name = F.concat(head, F.upper("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", S.domain(name).alias("domain"), S.report_domain(name).alias("report_domain"))


@query("""WITH q AS (SELECT conv_id, turn, lower(text) || CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN ' what is the impact, what if it has changed' WHEN 2 THEN ' trace where it comes from' WHEN 3 THEN ' compare a versus b' ELSE ' find and locate the pattern' END AS q FROM conversations),
 s AS (SELECT conv_id, turn, regexp_matches(q, 'analyze|analysis|examine|investigate|study')::INT + regexp_matches(q, 'what (is|are|does)|how (does|is|are)')::INT + regexp_matches(q, 'explain|describe|tell me about')::INT + regexp_matches(q, 'show me|find|search for')::INT AS a,
  regexp_matches(q, 'trace|lineage|flow|path|journey')::INT + regexp_matches(q, 'where (is|does|comes|goes)')::INT + regexp_matches(q, 'source|destination|origin')::INT + regexp_matches(q, 'upstream|downstream|dependencies')::INT AS l,
  regexp_matches(q, 'compare|difference|similar|contrast')::INT + regexp_matches(q, 'versus|vs|against|between')::INT + regexp_matches(q, 'same|different|alike')::INT AS c,
  regexp_matches(q, 'impact|effect|affect|change')::INT + regexp_matches(q, 'what happens if|what if')::INT + regexp_matches(q, 'consequences|result|outcome')::INT AS i,
  regexp_matches(q, 'find|search|look for|locate')::INT + regexp_matches(q, 'contains|includes|has')::INT + regexp_matches(q, 'pattern|like|similar to')::INT AS f FROM q)
 SELECT conv_id, turn, CASE WHEN greatest(a, l, c, i, f) = 0 THEN 'general' WHEN a = greatest(a, l, c, i, f) THEN 'analysis' WHEN l = greatest(l, c, i, f) THEN 'lineage' WHEN c = greatest(c, i, f) THEN 'comparison' WHEN i >= f THEN 'impact' ELSE 'search' END AS intent FROM s""")
def intent_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a question added by turn, which makes some of every kind."""
    asked = S.mapped(F.col("turn") % 5, {0: "", 1: " what is the impact, what if it has changed", 2: " trace where it comes from", 3: " compare a versus b", 4: " find and locate the pattern"}, "")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.intent(F.concat("text", asked)).alias("intent"))


@query("""WITH u AS (SELECT conv_id, turn, list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_-])([A-Z][A-Z0-9-]{2,})', 1), regexp_extract_all(text, '"([A-Za-z0-9_.-]+)"', 1)), regexp_extract_all(text, '(?i)program ([A-Za-z0-9_-]+)', 1)))) AS n FROM conversations)
 SELECT conv_id, turn, array_to_string(n, ',') AS names FROM u""")
def component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(N.component_names(F.col("text")), ",").alias("names"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


@query(f"""WITH c AS (SELECT p_partkey, {_CLEAN.format(x="p_type || ' ' || p_name")} AS c, {_CLEAN.format(x="p_size || ' ' || p_type")} AS d FROM part)
 SELECT p_partkey, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'col_' || c ELSE c END AS column_name, 'tbl_col_' || lower(d) AS table_name FROM c""")
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    tables = F.regexp_replace(N.clean_table(F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_type"))), "^col", "tbl_col")
    return part.select("p_partkey", N.clean_column(F.concat_ws(" ", "p_type", "p_name")).alias("column_name"), tables.alias("table_name"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", N.url_host(F.col("url")).alias("host"))


@query("""WITH p AS (SELECT DISTINCT user_id, CASE event_type WHEN 'click' THEN 'CREATE' WHEN 'view' THEN 'READ' WHEN 'purchase' THEN 'WRITE' ELSE 'ARCHIVE' END AS op FROM events)
 SELECT user_id, string_agg(op, ',' ORDER BY op) AS ops, round(sum(CASE op WHEN 'CREATE' THEN 0.2 WHEN 'READ' THEN 0.25 WHEN 'WRITE' THEN 0.15 ELSE 0.1 END)::DOUBLE, 4) AS completeness FROM p GROUP BY 1""")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "CREATE").when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "purchase", "WRITE").otherwise("ARCHIVE")
    ops = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(op)).alias("ops"))
    stages = F.transform("ops", lambda o: S.mapped(o, S.STAGE_OF))
    return ops.select("user_id", F.array_join("ops", ",").alias("ops"), F.round(S.completeness(stages), 4).alias("completeness"))


@query("""WITH c AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'N') AS reads, count(*) FILTER (l_returnflag = 'R') AS writes, count(*) FILTER (l_linenumber = 1) > 0 AS defined FROM lineitem GROUP BY 1)
 SELECT l_partkey, CASE WHEN defined AND reads + writes > 0 THEN 'ACTIVE_FIELD' WHEN reads > writes THEN 'READ_MOSTLY' WHEN writes > reads THEN 'WRITE_MOSTLY' ELSE 'BALANCED_USAGE' END AS pattern,
 CASE WHEN defined AND writes > 0 THEN 'ACTIVE' WHEN defined THEN 'DEFINED' WHEN reads > 0 THEN 'USED' ELSE 'UNKNOWN' END AS stage, CASE WHEN reads + writes = 0 THEN 'dead' WHEN writes = 0 THEN 'read_only' ELSE 'active' END AS life FROM c""")
def usage_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fields are used, their stage, and which are dead or only read; first lines of orders stand for definitions."""
    kind = F.when(F.col("l_returnflag") == "N", "READ").when(F.col("l_returnflag") == "R", "WRITE")
    first = F.col("l_linenumber") == 1
    c = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count_if(kind == "READ").alias("reads"), F.count_if(kind == "WRITE").alias("writes"), F.bool_or(first).alias("defined"), F.concat(F.collect_set(kind), F.collect_set(F.when(first, "DEFINE"))).alias("kinds"))
    life = F.when(F.col("reads") + F.col("writes") == 0, "dead").when(F.col("writes") == 0, "read_only").otherwise("active")
    return c.select("l_partkey", S.usage_pattern(F.col("defined"), F.col("reads"), F.col("writes")).alias("pattern"), S.lifecycle_stage(F.col("kinds")).alias("stage"), life.alias("life"))


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS p, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
 SELECT l_partkey, CASE WHEN p > 5 OR k > 3 THEN 'HIGH' WHEN p > 2 OR k > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c""")
def risk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return c.select("l_partkey", S.risk(F.col("p"), F.col("k")).alias("risk"))


@query("""SELECT CASE WHEN 3 * (h > 0.3)::INT + 2 * (s < 0.7)::INT + 2 * (d < 0.8)::INT >= 6 THEN 'HIGH' WHEN 3 * (h > 0.3)::INT + 2 * (s < 0.7)::INT + 2 * (d < 0.8)::INT >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, o_orderstatus
 FROM (SELECT o_orderstatus, avg((o_orderpriority = '1-URGENT')::INT) AS h, avg((o_totalprice > 100000)::INT) AS s, avg((o_totalprice > 50000)::INT) AS d FROM orders GROUP BY 1)""")
def system_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def share(c):
        return F.avg(c.cast("int"))

    g = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(share(F.col("o_orderpriority") == "1-URGENT").alias("h"), share(F.col("o_totalprice") > 100000).alias("s"), share(F.col("o_totalprice") > 50000).alias("d"))
    return g.select("o_orderstatus", S.system_risk(F.col("h"), F.col("s"), F.col("d")).alias("risk"))
