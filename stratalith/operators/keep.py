"""Where intermediate results are kept: the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set, in local mode alone."""
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    if not set_.isEmpty():
        return set_.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="stratalith-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession, name: str) -> str:
    """A name below the folder that nothing has yet."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written once; its lineage ends here."""
    folder(df.sparkSession)
    return df.checkpoint()


def by_value(name: str) -> None:
    """What a module defines goes to tasks with its code, so that executors need not have this package."""
    register_pickle_by_value(sys.modules[name])
