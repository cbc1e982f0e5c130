"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Workspace, free_names

#: A document's seeded place is a number of 60 bits, refined 12 bits at a time.
PLACE_BITS, STEP_BITS = 60, 12
KEY = ["__s", "__n"]


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, work: Workspace) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last, without gathering the sources in one task."""
    ordered = sources.orderBy("__n", "__s").withColumn("__at", F.monotonically_increasing_id())
    ordered = work.save(ordered, "sources")
    part = F.shiftright("__at", 33)
    # one row for each partition of the sort: a count bounded by the number of partitions
    before = ordered.groupBy(part.alias("__p")).count().select(
        "__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before")
    )
    return ordered.withColumn("__p", part).join(before, "__p").withColumn(
        "rank", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    ).drop("__p", "__before", "__at")


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """The level L at which weight * L, stopped at max_epochs * size, adds up to all sizes.

    Each turn clamps the sources whose share is above their cap and spreads what is left over the weights of the
    others. Clamping is a function of the level, so a turn is one distributed sum; one row comes to the driver.
    """
    level = 0.0
    for _ in range(10_000):
        over = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("fixed"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if not row["total"] or not row["free"]:
            return level
        new = (row["total"] - row["fixed"]) / row["free"]
        if new <= level:
            return level
        level = new
    raise RuntimeError("water-filling did not settle")


def _crossing(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Of each source's buckets (at most 2**STEP_BITS), the one in which the running size passes ``left``."""
    sums = rows.groupBy(*keys, step).agg(F.sum("size").alias("__sum"), F.first("left").alias("left"))
    run = Window.partitionBy(*keys).orderBy(step)
    sums = sums.withColumn("__end", F.sum("__sum").over(run)).withColumn("__start", F.col("__end") - F.col("__sum"))
    return sums.where("__start <= left and left < __end").select(*keys, step, (F.col("left") - F.col("__start")).alias("left"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix-17",
) -> DataFrame:
    """How often each document is taken so that sources get their weighted share of all words.

    Returns ``doc_id, source, size, source_size, target, repeats, taken``, one row for each row of ``docs``.
    Targets add up to all words: sources by code point (null last) weigh ``weights`` in turn, a target stops at
    ``max_epochs`` times its source's size and the excess goes to the others by weight. A source is repeated whole
    floor(target / size) times; for the rest, its documents are taken in the order of a seeded hash of their id as
    long as their middle word is inside what is left, so a source ends within half a document of its target.

    Null text counts no words; a null source is a source of its own; a source without words gets target 0; a null id
    is hashed as empty text; ids may be of any type that can be sorted; rows with one id share their place; an empty
    table gives no rows. Very long texts are documents like others: none is cut. Other columns are ignored. Only the ids and sizes are shuffled, never the texts. A hot source is summed before the shuffle, its
    running sums are over at most 4096 buckets at each of two levels, and the join back may be split by AQE.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__s"),
        F.col(source_col).isNull().cast("int").alias("__n"),
        word_count(F.col(text_col)).alias("size"),
        F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long").alias("__u"),
    )
    base = work.save(base, "base")
    first = F.shiftright("__u", PLACE_BITS - STEP_BITS)
    second = F.shiftright("__u", PLACE_BITS - 2 * STEP_BITS)

    sources = _ranked(base.groupBy(*KEY).agg(F.sum("size").alias("source_size")), work)
    choice = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.select(*KEY, "source_size", choice.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    sources = work.save(sources, "weighted")
    level = F.lit(water_level(sources, max_epochs))
    target = F.least(F.col("weight") * level, F.col("cap").cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = sources.select(*KEY, "source_size", target.alias("target")).withColumn("whole", whole)
    plan = plan.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))

    rows = base.join(plan.select(*KEY, "left"), KEY)
    one = _crossing(rows.withColumn("__b1", first), KEY, "__b1")
    rows = base.withColumn("__b1", first).join(one, [*KEY, "__b1"]).withColumn("__b2", second)
    two = _crossing(rows, [*KEY, "__b1"], "__b2")
    # what is left in one of 2**24 buckets is a few documents of a source
    kind = docs.schema[id_col].dataType
    place = F.struct(F.col("__u"), F.col("doc_id").isNotNull().cast("int").alias("__k"), F.col("doc_id").alias("__i"))
    last = base.withColumn("__b1", first).withColumn("__b2", second).join(two, [*KEY, "__b1", "__b2"]).withColumn("__at", place)
    run = F.sum("size").over(Window.partitionBy(*KEY).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("__in", 2 * run - F.col("size") <= 2 * F.col("left"))
    floor_at = F.struct((F.shiftleft("__b2", PLACE_BITS - 2 * STEP_BITS) - 1).alias("__u"), F.lit(2).alias("__k"), F.lit(None).cast(kind).alias("__i"))
    cut = last.groupBy(*KEY).agg(F.coalesce(F.max(F.when(F.col("__in"), F.col("__at"))), F.min(floor_at)).alias("__cut"))
    plan = work.save(plan.join(cut, KEY, "left").select(*KEY, "source_size", "target", "whole", "__cut"), "plan")

    repeats = (F.col("whole") + F.when(place <= F.col("__cut"), 1).otherwise(0)).cast("long")
    return base.join(plan, KEY).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row repeated as often as :func:`mix` takes its document; the columns stay the same.

    Rows that share an id share a decision, so ids are assumed to name documents. Columns keep their names and values,
    whatever the names.
    """
    id_col = how.get("id_col", "doc_id")
    i, n, turn = free_names(docs, "id", "repeats", "turn")
    keep = mix(docs, **how).where("repeats > 0").groupBy("doc_id").agg(F.max("repeats").cast("int").alias(n))
    out = docs.join(keep.withColumnRenamed("doc_id", i), F.col(id_col).eqNullSafe(F.col(i)))
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
