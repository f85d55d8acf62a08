"""What the findings of round 4 were about: case as SQL has it, joins that the driver holds no side of."""

import duckdb
from pyspark.sql import functions as F

from stratalith.operators import program
from stratalith.plans import catalog


def test_sharp_s_makes_no_code(spark, tmp_path):
    """The upper case of one letter is one letter: with SS for a sharp s these texts would have CLASS and two more words of code."""
    texts = ["die claß def if " + "wort " * 40, "ﬁne deﬀ if else " + "wort " * 40, "claſs def else " + "wort " * 40, "class def ıf " + "wort " * 40, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["token_estimate"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.ORACLES["token_estimate"]).fetchall())


def test_lineage_broadcasts_nothing(spark, sf_dir):
    """No step of it, whatever is written in between, sends made rows through the driver."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    catalog.QUERIES["value_lineage"](spark, sf_dir).count()
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert len(plans) > 2 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_statements_of_some_verbs(spark):
    """What control flow asks for is a part of all statements, in the same order; verbs in names, literals and EXEC are none."""
    text = "PROCEDURE DIVISION USING A.\nS SECTION.\nGO-ON.\n    MOVE A TO B IF X PERFORM GO-ON\n      UNTIL Y END-IF DISPLAY 'STOP RUN' . STOP\n    RUN.\n    EXEC SQL IF A. GO END-EXEC GO\n TO GO-ON. EXIT. IF(Y) PERFORM. EXIT\tPROGRAM.\nP2.\n  GOBACK."
    df = spark.createDataFrame([(1, text), (2, None), (3, "PROCEDURE DIVISION. STOP")], "k int, t string")
    columns = ["k", "line", "section", "paragraph", "place", "sentence", "verb", "body", "conditional"]
    every = program.statements(df, "k", "t").where(F.col("verb").isin(*program.STEERING)).orderBy("k", "n").select(columns).collect()
    some = program.statements(df, "k", "t", program.STEERING).orderBy("k", "n")
    assert some.select(columns).collect() == every and len(every) > 12 and [r["n"] for r in some.where("k = 1").collect()] == list(range(len(every) - 2))
