"""Chunks of documents: overlapping windows of characters, and packed sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as tx


def char_windows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, piece): pieces of at most ``size`` characters that end at a space where there is one, the next starting
    ``overlap`` before that end. A text that fits is one piece. Where the last space lies within ``overlap`` of the
    start, so that the next piece would not get on, the piece is cut at ``size``."""
    if len(text) <= size:
        return [(0, text)]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = text.rfind(" ", start, end)
            end = space if space > start + overlap else end
        piece = text[start:end].strip()
        if piece:
            out.append((start, piece))
        start = end - overlap
    return out


def char_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``doc_id, chunk_id, start, text``. Where a window ends depends on the one before, so this is a Python function
    over Arrow batches; it needs no shuffle. Null texts have no chunks."""
    size, overlap = cfg.vector_chunk_chars, cfg.vector_chunk_overlap

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, k, start, piece) for i, t in zip(batch["doc_id"], batch["text"]) for k, (start, piece) in enumerate(char_windows(t, size, overlap))
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "start", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(run, f"doc_id {kind}, chunk_id int, start int, text string")


def _append(chunks: Column, current: Column, piece: Column, glue: str, size: int) -> tuple[Column, Column]:
    joined = F.when(current == "", piece).otherwise(F.concat(current, F.lit(glue), piece))
    fits = F.length(joined) <= size
    return (
        F.when(fits | (current == ""), chunks).otherwise(F.concat(chunks, F.array(current))),
        F.when(fits, joined).otherwise(piece),
    )


def _pack(pieces: Column, glue: str, size: int) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

    def step(acc, piece):
        done, current = _append(acc["done"], acc["current"], piece, glue, size)
        return F.struct(done.alias("done"), current.alias("current"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["current"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["current"]))))


def packed(blocks: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """An array of blocks as at most ``max_chunks`` chunks of at most ``chunk_chars`` characters: blocks joined by a
    blank line as long as they fit; a longer block is packed from its sentences first, a longer sentence cut."""
    size = cfg.chunk_chars
    cuts = lambda s: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda k: F.trim(F.substring(s, k * size + 1, F.lit(size)))
    )
    split = lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(cuts(s))
    pieces = lambda b: F.when(F.length(b) <= size, F.array(b)).otherwise(
        _pack(F.flatten(F.transform(tx.sentences(b), split)), " ", size)
    )
    clean = F.filter(F.transform(blocks, tx.squeeze), lambda b: b != "")
    return F.slice(_pack(F.flatten(F.transform(clean, pieces)), "\n\n", size), 1, cfg.max_chunks)
