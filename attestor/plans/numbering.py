"""Row numbers over a whole table without ordering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, counting from 0 in ``order``: a range sort, numbers inside each partition, and a running sum over
    one row per partition. The sorted rows are written, so each keeps its number."""
    ordered = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ordered = written(ordered, "numbered")
    sizes = ordered.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count"))
    out = ordered.join(sizes.drop("count"), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1))
    return out.drop("__part", "__at", "__before")
