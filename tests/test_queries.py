"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import duckdb
import pytest

from stratalith.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def shown(v):
    if v is None or v != v:
        return "None"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def rows_of(names, columns, rows):
    at = [columns.index(n) for n in names]
    return sorted(tuple(shown(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(sorted(columns), df.columns, df.collect()) == rows_of(sorted(columns), columns, got.fetchall())


def test_state_of_the_stream_is_that_of_the_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    stream = {r["key"]: (r["longest"], r["opened"]) for r in catalog.QUERIES["stream_breaker"](spark, sf_dir).collect()}
    batch = catalog.QUERIES["breaker_states"](spark, sf_dir).groupBy("user_id").agg(F.max("failures_in_row").alias("m"), F.max("open").alias("o")).collect()
    assert stream == {r["user_id"]: (r["m"], r["o"]) for r in batch}
