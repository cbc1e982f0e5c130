"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of normalised text in a block.
BLOCK = 4096


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def block_print(block: bytes) -> int:
    """A place for a block in the shuffle. Blocks with one print are told apart by their bytes."""
    return xxhash.xxh64_intdigest(block) - (1 << 63)


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _block_rows(docs: DataFrame, size: int, prints, *, content: bool) -> DataFrame:
    """With ``content`` the blocks themselves, each once per batch: ``h, block``. Else where they stand:
    ``id, row, n, pos, h, sha``, with the whole text's SHA-256 at position 0; ``row`` names the row in its task."""

    def whole(batches):
        for batch in batches:
            seen = {b for t in batch.column("text") for b in _blocks(normalised(t.as_py()), size)}
            seen = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(map(prints, seen), pa.int64()), pa.array(seen, pa.binary())], ["h", "block"])

    def places(batches):
        for batch in batches:
            at, n, pos, h, sha = [], [], [], [], []
            for k, t in enumerate(batch.column("text")):
                data = normalised(t.as_py())
                own = _blocks(data, size)
                at += [k] * len(own)
                n += [len(own)] * len(own)
                pos += range(len(own))
                h += map(prints, own)
                sha += [hashlib.sha256(data).hexdigest()] + [None] * (len(own) - 1)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take),
                    batch.column("row").take(take),
                    pa.array(n, pa.int64()),
                    pa.array(pos, pa.int64()),
                    pa.array(h, pa.int64()),
                    pa.array(sha, pa.string()),
                ],
                ["id", "row", "n", "pos", "h", "sha"],
            )

    if content:
        return docs.select("text").mapInArrow(whole, "h long, block binary")
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(places, f"id {kind}, row long, n long, pos long, h long, sha string")


def _named(distinct: DataFrame, by: list[str], work: Workspace, table: str, keep: list[str]) -> DataFrame:
    """Names different rows by integers: each task sorts its rows and numbers them after those of the tasks before
    it. Written at once, so that a name is given only once."""
    order = distinct.sortWithinPartitions(*by)
    return work.save(order.select(*keep, F.monotonically_increasing_id().alias("name")), table)


def name_texts(docs: DataFrame, work: Workspace, block: int = BLOCK, prints=block_print) -> DataFrame:
    """``id, row, level, name, sha``: two rows have one (level, name) exactly where their normalised texts are equal.

    ``docs`` has ``id, row, text``. Texts are cut into blocks of ``block`` bytes; different blocks are sorted and
    named by integers; names of neighbours are paired and each different pair is named anew, level by level, until
    each text has one name. A text of one block is done at once and only longer ones go on, so the work of all
    levels is a small part of the first. A block's bytes are shuffled once, after copies in one task were merged.
    They return to their places by their prints; the bytes decide for prints that different blocks share. Places are
    written once, so a row keeps its number whatever is read again.
    """
    stand = work.save(_block_rows(docs, block, prints, content=False), "places")
    different = _block_rows(docs, block, prints, content=True).groupBy("h", "block").agg(F.count(F.lit(1)).alias("c"))
    names = _named(different, ["block"], work, "names", ["h"])
    sure = work.save(names.groupBy("h").agg(F.min("name").alias("name"), F.max("name").alias("last")), "prints")
    clash = work.save(sure.where("name <> last").select("h"), "clash")
    found = stand.join(sure.where("name = last").select("h", "name"), "h")
    if not clash.isEmpty():
        found = found.unionByName(_by_content(docs, stand, block, prints, clash, work))
    found = work.save(found.select("id", "row", "n", "pos", "name", "sha"), "level_0")
    work.drop("names")

    out = found.where("n = 1").select("id", "row", F.lit(0).alias("level"), "name", "sha")
    current, level = found.where("n > 1").drop("sha"), 0
    shas = found.where("n > 1 and pos = 0").select("row", "sha")
    done = None
    while not current.isEmpty():
        level += 1
        pairs = current.groupBy("id", "row", "n", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos").bitwiseAND(1) == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos").bitwiseAND(1) == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = work.save(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("long")), f"pairs_{level}")
        named = _named(pairs.select("a", "b").distinct(), ["a", "b"], work, f"names_{level}", ["a", "b"])
        rows = work.save(pairs.join(named, ["a", "b"]).select("id", "row", "n", "pos", "name"), f"level_{level}")
        work.drop(f"pairs_{level}")
        ready = rows.where("n = 1").select("id", "row", F.lit(level).alias("level"), "name")
        done = ready if done is None else done.unionByName(ready)
        current = rows.where("n > 1")
    if done is None:
        return out
    return out.unionByName(done.join(shas, "row").select("id", "row", "level", "name", "sha"))


def _by_content(docs: DataFrame, stand: DataFrame, block: int, prints, clash: DataFrame, work: Workspace) -> DataFrame:
    """Places of the blocks whose print several blocks share, named by bytes. Their names are below -1, so they meet
    no other name. A text's digest and the place say which block it is."""

    def run(batches):
        for batch in batches:
            rows = set()
            for t in batch.column("text"):
                data = normalised(t.as_py())
                own = _blocks(data, block)
                rows |= {(hashlib.sha256(data).hexdigest(), p, prints(b), b) for p, b in enumerate(own)}
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["text_sha", "pos", "h", "block"])

    rows = docs.select("text").mapInArrow(run, "text_sha string, pos long, h long, block binary").join(clash, "h", "left_semi").distinct()
    named = _named(rows.select("block").distinct(), ["block"], work, "clash_names", ["block"])
    named = work.save(rows.join(named, "block").select("text_sha", "pos", (-F.col("name") - 2).alias("name")), "clash_places")
    texts = stand.where("pos = 0").select("row", F.col("sha").alias("text_sha"))
    return stand.join(clash, "h", "left_semi").join(texts, "row").join(named, ["text_sha", "pos"]).select("h", "id", "row", "n", "pos", "sha", "name")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, prints=block_print) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs``.

    Texts are equal when they are identical after lower-casing A-Z only; null counts as empty. Of equal texts the row
    with the largest doc_id stays; of rows that share that id too, one is marked as kept. A null id is smaller than
    any other: a group of null ids keeps one of them and has ``keep_id`` null. ``group_size`` counts rows. A very long
    text is many blocks, which are shuffled and named apart, so no task holds more than it read. An empty table gives no
    rows; other columns are ignored.

    Groups are formed by partial aggregation and joined back, so a group that holds a third of all rows is neither
    gathered nor sorted in one task.
    """
    work = Workspace(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    named = work.save(name_texts(rows, work, block, prints), "named")
    best = F.max(F.struct(F.col("id"), F.col("row")))
    # written, so that the join below reads two plain shuffles and AQE may split a large group
    groups = work.save(named.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
