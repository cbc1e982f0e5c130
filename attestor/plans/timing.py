"""Seconds and rows of each step of a run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Observation

from .shared import written


class Steps:
    """Runs steps one after the other, each written into the shared folder, and keeps how long each took and how many rows
    it gave; rows are counted while they are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def run(self, name: str, df: DataFrame) -> DataFrame:
        seen, began = Observation(), time.perf_counter()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        self.rows.append((len(self.rows), name, round(time.perf_counter() - began, 3), int(seen.get["rows"])))
        return out

    def table(self) -> DataFrame:
        """``step, name, seconds, rows`` and, last, the total."""
        total = (len(self.rows), "total", round(sum(r[2] for r in self.rows), 3), None)
        return self.spark.createDataFrame([*self.rows, total], "step int, name string, seconds double, rows long")
