"""Where intermediate data goes: the folder in spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The folder that the session names. On one machine, as in tests, a temporary one stands in for it."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if not named and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or tempfile.mkdtemp(prefix="cubespark-")).rstrip("/")


def folder(spark: SparkSession, kind: str) -> str:
    """A new name in it."""
    return f"{base(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable copy. With spark.cleaner.referenceTracking.cleanCheckpoints copies go when unused."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base(df.sparkSession))
    return df.checkpoint(eager=True)
