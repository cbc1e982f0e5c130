"""Bounded, deterministic samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_text


def held_out(id_col, folds: int, fold: int):
    """True for the rows that no model may learn from."""
    return crc32_text(id_col) % folds == fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, label: str, folds: int, fold: int, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of each class, those with the smallest hash of their id, held-out rows excluded.

    The ids are chosen from the narrow label table first, so only the chosen texts leave the scan. Rows with null id,
    null text or another label than 0 and 1 are not used; of labels that disagree on an id, the largest counts; of
    texts that share an id, that with the smallest hash. Reruns agree.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label).alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("i").agg(F.max("y").alias("y")).where(~held_out(F.col("i"), folds, fold)).withColumn("h", F.xxhash64(F.col("i").cast("string")))
    chosen: list = []
    for y in (0, 1):
        chosen += [(r[0], y) for r in known.where(F.col("y") == y).orderBy("h", "i").limit(per_class).select("i").collect()]
    if not chosen:
        return []
    which = dict(chosen)
    kind = docs.schema[id_col].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame([(i,) for i in which], f"i {kind}")
    picked = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    picked = picked.join(F.broadcast(ids), "i", "left_semi")
    rows = picked.groupBy("i").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).collect()  # 2 * per_class rows at most
    return [(r["m"]["text"], which[r["i"]]) for r in sorted(rows, key=lambda r: r["i"])]
