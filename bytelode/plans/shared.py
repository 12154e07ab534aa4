"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset and Spark runs in one process, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("bytelode.scratch.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="bytelode-")
        spark.conf.set("bytelode.scratch.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet and read back: what it took to make it is not done again, whatever is lost."""
    path = f"{folder(df.sparkSession)}/bytelode-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
