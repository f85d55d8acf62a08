"""Gathered facts, documents, plans and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as U
from ..operators import documents as D
from .catalog import query, read


@query("""SELECT l_orderkey, l_partkey, l_linenumber, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_discount DESC, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1""")
def max_confidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return D.strongest(lines, ["l_orderkey", "l_partkey"], "l_discount", ["l_linenumber", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")


_FACTS = "f AS (SELECT source, count(*) AS n_chunks, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS kinds, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1)"


@query(f"WITH {_FACTS} SELECT * FROM f")
def program_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.program_facts(read(spark, sf_dir, "documents"), "source", "lang", "text")


@query(f"WITH {_FACTS} SELECT source, 'Program ' || source || chr(10) || 'Chunks: ' || n_chunks || chr(10) || 'Kinds: ' || kinds || chr(10) || 'Size: ' || n_chars || ' characters' AS document FROM f")
def program_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.program_document(program_facts(spark, sf_dir), "source")


_RISK = "r AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS p, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, p, CASE WHEN k > 250 THEN 'HIGH' WHEN k > 200 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r)"


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return g.withColumn("risk", F.when(F.col("k") > 250, "HIGH").when(F.col("k") > 200, "MEDIUM").otherwise("LOW"))


@query(f"WITH {_RISK} SELECT l_suppkey, risk, CASE WHEN risk = 'LOW' AND p > 2 THEN 1 WHEN risk = 'HIGH' THEN 3 ELSE 2 END AS phase FROM s")
def migration_roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.plan_phases(_risks(spark, sf_dir), F.col("risk"), F.col("p")).select("l_suppkey", "risk", "phase")


@query(f"WITH {_RISK} SELECT l_suppkey, CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END + p AS priority FROM s ORDER BY priority DESC, l_suppkey LIMIT 5")
def top_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five components to look at first (a top-k report)."""
    return D.priorities(_risks(spark, sf_dir), "l_suppkey", F.col("risk"), F.col("p"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'anti') OR contains(lower(source), 'anti') OR contains(lower(lang), 'anti')")
def search_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.found(read(spark, sf_dir, "documents"), ["text", "source", "lang"], "ANTI").select("doc_id", "source")


@query("SELECT conv_id, turn, substr(text, 1, 100) AS preview FROM conversations WHERE contains(lower(text), 'the')")
def search_chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a text in them, each with its first hundred characters (a preview is the feature)."""
    return D.found(read(spark, sf_dir, "conversations"), ["text"], "The").select("conv_id", "turn", F.substring("text", 1, 100).alias("preview"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND contains(CAST(user_id AS VARCHAR), '1')")
def filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("status", F.col("event_type"))
    # The age counts from the newest row of all, so the window comes before the status.
    return D.filtered(D.filtered(rows, newer=("ts", "7 days")), status="click", name=("user_id", "1")).select("event_id", "event_type")


@query("SELECT conv_id, count(*) FILTER (role <> 'system') AS n_ok, count(*) FILTER (role = 'system') AS n_failed, md5(coalesce(string_agg(CASE WHEN role <> 'system' THEN text END, ' ' ORDER BY turn, text), '')) AS digest FROM conversations GROUP BY 1")
def combine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.combined(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", F.col("role") != "system").withColumn("digest", F.md5("text")).drop("text")


@query("""WITH g AS (SELECT p_brand, max((p_size = 13)::INT) AS s, max((p_size % 4 = 0)::INT) AS w, max(p_size) AS m, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1)
 SELECT p_brand, CASE WHEN s = 1 THEN 'hardware_alignment' WHEN w = 1 THEN 'word_boundary' WHEN m > 100 THEN 'padding' ELSE 'filler' END AS purpose, CASE WHEN total > 1000 THEN 'high' WHEN total > 100 THEN 'medium' ELSE 'low' END AS waste, total FROM g""")
def filler_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.padding(read(spark, sf_dir, "part"), "p_brand", "p_size", F.col("p_size") == 13)


@query("""WITH o AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'creation' WHEN 'view' THEN 'active_usage' WHEN 'purchase' THEN 'updates' ELSE 'other' END AS stage FROM events),
 d AS (SELECT DISTINCT user_id, stage FROM o) SELECT user_id, (SELECT count(*) FROM o WHERE o.user_id = d.user_id) AS n, string_agg(stage, ',' ORDER BY stage) AS stages, round(sum(CASE stage WHEN 'creation' THEN 0.2 WHEN 'active_usage' THEN 0.25 WHEN 'updates' THEN 0.15 ELSE 0 END)::DOUBLE, 4) AS completeness FROM d GROUP BY user_id""")
def file_lifecycle_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", "CREATE").when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "purchase", "DELETE").otherwise("LOOK")
    return D.stages(read(spark, sf_dir, "events"), "user_id", op)


@query("""WITH f AS (SELECT p_partkey, p_size AS k, CASE p_size % 12 WHEN 0 THEN 'CUSTOMER-ID' WHEN 1 THEN 'ACCOUNT-NUM' WHEN 2 THEN 'TXN-DATE' WHEN 3 THEN 'ORD-AMOUNT' WHEN 4 THEN 'BALANCE' WHEN 5 THEN 'STATUS-CODE' WHEN 6 THEN 'WORK-NAME'
  WHEN 7 THEN 'ADDRESS' WHEN 8 THEN 'PHONE' WHEN 9 THEN 'MASTER' ELSE 'F-' || upper(split_part(p_name, ' ', 1)) END AS n, CASE p_size % 3 WHEN 0 THEN 'X(' || p_size || ')' WHEN 1 THEN 'S9(4)' ELSE 'Z' END AS p FROM part)
 SELECT p_partkey, CASE WHEN regexp_matches(n, 'CUSTOMER|CUST') THEN 'customer_data' WHEN regexp_matches(n, 'ORDER|ORD') THEN 'order_data' WHEN regexp_matches(n, 'ACCOUNT|ACCT') THEN 'account_data' WHEN regexp_matches(n, 'TRANS|TXN') THEN 'transaction_data' WHEN regexp_matches(n, 'IND|NULL') THEN 'indicator_variables'
  WHEN regexp_matches(n, 'WORK|TEMP') THEN 'working_variables' WHEN starts_with(p, 'S9') THEN 'numeric_data' WHEN starts_with(p, 'X') THEN 'character_data' ELSE 'general_purpose' END AS purpose,
  CASE WHEN contains(n, 'CUSTOMER') AND contains(n, 'ID') THEN 'Customer identification for CRM and transaction tracking' WHEN contains(n, 'ACCOUNT') AND (contains(n, 'NUM') OR contains(n, 'ID')) THEN 'Account number for financial transaction processing' WHEN contains(n, 'BALANCE') THEN 'Financial balance for accounting and reporting'
   WHEN contains(n, 'DATE') THEN 'Date field for temporal tracking and reporting' WHEN contains(n, 'AMOUNT') THEN 'Monetary amount for financial calculations' WHEN contains(n, 'STATUS') THEN 'Status indicator for workflow and business rule processing' WHEN contains(n, 'NAME') THEN 'Name field for identification and correspondence'
   WHEN contains(p, 'X') THEN 'Text/character data (' || k || ' chars max)' WHEN contains(p, '9') THEN 'Numeric data for calculations and processing' ELSE 'Business data field for operational processing' END AS meaning,
  CASE WHEN regexp_matches(n, 'CUSTOMER|CUST') THEN 'Customer data read for CRM operations' WHEN regexp_matches(n, 'ACCOUNT|ACCT') THEN 'Account read for financial processing' WHEN regexp_matches(n, 'TRANSACTION|TXN') THEN 'Transaction read for payment processing' WHEN contains(n, 'BALANCE') THEN 'Balance read for accounting operations'
   WHEN contains(n, 'MASTER') THEN 'Master data read for reference management' WHEN regexp_matches(n, 'TEMP|WORK') THEN 'Temporary read for intermediate processing' ELSE 'File read operation' END AS context,
  CASE WHEN contains(n, 'DATE') THEN 'Date format conversion (YYYYMMDD vs DD/MM/YYYY)' WHEN contains(n, 'AMOUNT') OR contains(n, 'BALANCE') THEN 'Financial amount format conversion (signed vs unsigned)' WHEN contains(n, 'CODE') THEN 'Code interpretation (numeric vs character representation)' ELSE 'Data format transformation for different processing needs' END AS redefines,
  CASE WHEN regexp_matches(n, 'TRANSACTION|TXN') THEN 'Transaction history array (' || k || ' transactions max)' WHEN contains(n, 'BALANCE') THEN 'Multi-currency or multi-account balance array (' || k || ' entries)' WHEN contains(n, 'ADDRESS') THEN 'Multiple address lines (' || k || ' lines max)'
   WHEN contains(n, 'PHONE') THEN 'Multiple phone numbers (' || k || ' numbers max)' ELSE 'Repeating data structure for bulk processing (' || k || ' entries)' END AS occurs FROM f""")
def business_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for fields and files: names and pictures come from their size and name."""
    k = F.col("p_size")
    names = dict(enumerate(("CUSTOMER-ID", "ACCOUNT-NUM", "TXN-DATE", "ORD-AMOUNT", "BALANCE", "STATUS-CODE", "WORK-NAME", "ADDRESS", "PHONE", "MASTER")))
    n = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[k % 12], F.concat(F.lit("F-"), F.upper(F.split("p_name", " ")[0])))
    p = F.when(k % 3 == 0, F.concat(F.lit("X("), k, F.lit(")"))).when(k % 3 == 1, "S9(4)").otherwise("Z")
    fields = read(spark, sf_dir, "part").select("p_partkey", k.alias("k"), n.alias("n"), p.alias("p"))
    n, p = F.col("n"), F.col("p")
    return fields.select("p_partkey", U.host_purpose(n, F.concat(F.lit("05 F PIC "), p)).alias("purpose"), U.field_meaning(n, p).alias("meaning"), U.file_context(n, F.lit("READ")).alias("context"),
                         U.redefines_purpose(n, F.lit("OLD-DATE")).alias("redefines"), U.occurs_purpose(n, F.col("k")).alias("occurs"))


@query("""SELECT doc_id, length(trim(text)) >= 10 AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '*'))) > 0 AS valid,
 substr(regexp_replace(source || '_' || lang, '[^A-Za-z0-9_]', '_', 'g'), 1, 60) || '_' || substr(md5(text), 1, 8) AS chunk_id FROM documents""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", U.valid_chunk(t).alias("valid"), U.chunk_id(F.col("source"), F.col("lang"), t).alias("chunk_id"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN replace(props, '}', ',}') WHEN 2 THEN NULL ELSE props END AS json FROM events""".replace("replace(props, '}', ',}')", "props"))
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of answers: bare, with a comma too many, missing, inside prose."""
    props, kind = F.col("props"), F.col("event_id") % 4
    answer = F.when(kind == 0, props).when(kind == 1, F.replace(props, F.lit("}"), F.lit(",}"))).when(kind == 2, F.lit("no {json here")).otherwise(F.concat(F.lit("Here it is: "), props, F.lit(" as asked")))
    return read(spark, sf_dir, "events").select("event_id", U.salvaged_json(answer).alias("json"))


@query("""WITH d AS (SELECT source, count(DISTINCT lang) AS k, count(*) AS n FROM documents GROUP BY 1) SELECT source, CASE WHEN k > 1 AND n > 3 THEN 'HIGH' WHEN k > 1 OR n > 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d""")
def sync_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("k"), F.count("*").alias("n"))
    return d.select("source", U.sync_risk(F.col("k"), F.col("n")).alias("risk"))


@query("""SELECT * FROM (VALUES (0, 'conditional,file_operations', 'mixed'), (1, 'calculations,loops', 'mixed'), (2, '', 'online'), (3, 'validation', 'reporting')) t(id, patterns, kind)""")
def logic_patterns_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "IF A > 1\n  READ F"), (1, "PERFORM X UNTIL Y\nADD 1 TO B"), (2, "EXEC CICS RETURN"), (3, "NUMERIC CHECK FOR REPORT")]
    df = spark.createDataFrame(rows, "id int, t string")
    return df.select("id", F.array_join(U.logic_patterns(F.col("t")), ",").alias("patterns"), U.processing_kind(F.col("t"), F.lit(0)).alias("kind"))
