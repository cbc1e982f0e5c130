"""Blocks, sentences and overlapping segments of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as tx


def blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, block_index, text`` and the columns ``keep``: lines of at least ``min_chars`` characters after trimming.
    ``block_index`` counts all lines. Null and empty texts have no blocks."""
    lines = docs.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("block_index", "text"))
    return lines.withColumn("text", F.trim("text")).where(F.length("text") >= min_chars)


def sentences(blocks: DataFrame, cfg: EngineConfig = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, block_index, sent_index, text, token_count``: sentences of a block; short ones are dropped, but
    ``sent_index`` counts them."""
    rows = blocks.select("doc_id", *keep, "block_index", F.posexplode(tx.sentences(F.col("text"))).alias("sent_index", "text"))
    rows = rows.where(F.length("text") >= cfg.min_sentence_chars)
    return rows.withColumn("token_count", F.size(tx.words(F.col("text"), r"[\p{L}\p{N}_]+")))


def segments(sentences: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Windows of ``segment_size`` sentences of a block that share ``segment_overlap`` with the next, without windows
    of too few tokens: ``doc_id, block_index, window, text, token_count, sentence_count, sent_indexes``.

    A sentence goes to each of the at most two windows that hold it, and windows are gathered by an aggregate; a
    block's sentences are numbered in a window function over one block."""
    step = cfg.segment_size - cfg.segment_overlap
    if cfg.segment_overlap >= step:
        raise ValueError("segments may overlap with their direct neighbours only")
    pos = F.row_number().over(Window.partitionBy("doc_id", "block_index").orderBy("sent_index")) - 1
    own = F.floor(F.col("pos") / step).cast("int")
    before = F.when((F.col("pos") % step < cfg.segment_overlap) & (F.col("pos") >= step), own - 1)
    rows = sentences.withColumn("pos", pos).withColumn("window", F.explode(F.array_compact(F.array(own, before))))
    item = F.struct("pos", "text", "token_count", "sent_index")
    got = rows.groupBy("doc_id", "block_index", "window").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = got.select(
        "doc_id",
        "block_index",
        "window",
        F.array_join("items.text", " ").alias("text"),
        F.aggregate("items.token_count", F.lit(0), lambda a, x: a + x).alias("token_count"),
        F.size("items").alias("sentence_count"),
        F.col("items.sent_index").alias("sent_indexes"),
    )
    return out.where(F.col("token_count") >= cfg.min_segment_tokens)


def number_segments(segments: DataFrame) -> DataFrame:
    """Adds ``seg_index``, consecutive over a document's surviving windows."""
    order = Window.partitionBy("doc_id").orderBy("block_index", "window")
    return segments.withColumn("seg_index", F.row_number().over(order) - 1)


def sentence_segments(sentences: DataFrame, numbered: DataFrame) -> DataFrame:
    """``sentences`` with ``segment_id``: the last surviving window that holds a sentence, null if none does."""
    bridge = numbered.select("doc_id", "block_index", F.explode("sent_indexes").alias("sent_index"), "seg_index")
    last = bridge.groupBy("doc_id", "block_index", "sent_index").agg(F.max("seg_index").alias("segment_id"))
    return sentences.join(last, ["doc_id", "block_index", "sent_index"], "left")


def block_stats(blocks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences and their tokens in each block; zeros for a block without any."""
    per = sentences.groupBy("doc_id", "block_index").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum("token_count").alias("tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
    )
    out = blocks.select("doc_id", "block_index").join(per, ["doc_id", "block_index"], "left").na.fill(0)
    average = F.when(F.col("sentences") > 0, F.floor(F.col("tokens") / F.col("sentences") * 10 + 0.5) / 10).otherwise(F.lit(0.0))
    return out.withColumn("avg_tokens", average)


def article_stats(block_stats: DataFrame, segments: DataFrame) -> DataFrame:
    """Per document: blocks, sentences, tokens, segments and its blocks' statistics as a list."""
    item = F.struct("block_index", "sentences", "tokens")
    per = block_stats.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("sentences").alias("sentences"),
        F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(item)).alias("per_block"),
    )
    seg = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"))
    return per.join(seg, "doc_id", "left").na.fill(0, ["segments"])
