"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests) a temporary folder is created once and set for the session; on a
    cluster that would be another folder on each machine, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("attestor.local.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("attestor.local.dir", path)
    return path.rstrip("/")


class Workspace:
    """Tables that a query writes into the shared folder to cut lineage.

    ``save`` writes a DataFrame once and returns it as read back, so a lost executor costs a re-read and
    never a recomputation with other row numbers. ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/attestor/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, in any case."""
    held = {c.lower() for c in df.columns}
    return [next(n for n in (f"__{w}{k or ''}" for k in range(len(held) + 1)) if n not in held) for w in wanted]


def tasks_for(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks for an explicit repartition, which AQE leaves alone: so many that none holds much more than ``each``, and
    the session's shuffle partitions at least."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(amount) // each))


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, UPPER.lower())


def crc32_text(col: Column) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
