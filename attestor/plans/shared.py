"""Tables written into the folder that driver and executors share, to cut lineage and to make numbers stable."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("attestor.local.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("attestor.local.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: a lost executor costs a read, never a recomputation with other numbers."""
    path = f"{folder(df.sparkSession)}/attestor/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
