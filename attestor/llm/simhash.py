"""SimHash near-duplicates: fingerprints, links found with pivot distance tables, connected components."""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_pairs as sets
from .common import Workspace, free_names, tasks_for
from .components import connected_components, joined
from .shingle_pairs import shingle_hashes

#: References are random 64-bit words of a fixed generator, the same on every executor.
PIVOTS = 32
#: Links differ in at most so many bits. A fingerprint is cut into at least RADIUS + 2 segments, of which a link leaves
#: all but RADIUS equal.
RADIUS = 3
#: Fingerprints that share a key are compared in blocks of this many; groups of up to SMALL all at once.
BLOCK, SMALL = 4096, 16
#: Dealt rows that one task holds.
TASK_ROWS = 4_000_000


def bits_of(hashes: np.ndarray) -> int:
    """64 bits as a signed long: bit i is set where over half of the hashes have it set; 0 for no hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # eight counters in each 64-bit word; 255 rows cannot overflow one
        lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        total += lanes.view(np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The bits of the text's shingles as an unsigned number."""
    return bits_of(shingle_hashes(text, words)) & (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, h, text``; id and ``h``, a hash of the text, name a row."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, h, fp`` (a signed long) for each row of ``docs``."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            fps = [bits_of(shingle_hashes(t.as_py(), words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "h", "fp"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind.simpleString()}, h long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, count, np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The Hamming distances of each fingerprint (rows) to each reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).view(np.int8)


def segment_masks(segments: int) -> list[int]:
    """Masks of the even segments that 64 bits are cut into."""
    ends = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]


def segments_for(count: int, radius: int = RADIUS) -> int:
    """Segments at which ``count`` random fingerprints leave at most two in a key."""
    need = log2(max(count, 2)) - 1
    return next((m for m in range(radius + 2, 2 * radius + 8) if 64 * (m - radius) / m >= need), 2 * radius + 8)


def pivot_keys(fps: np.ndarray, segments: int, radius: int = RADIUS, count: int = PIVOTS) -> np.ndarray:
    """The keys of fingerprints (rows), one for each choice of ``segments - radius`` segments.

    Each segment has a pivot table, the distances inside the segment to all references. Two fingerprints within
    ``radius`` bits have equal rows in at least so many tables, so for one choice all coordinates agree. A key is a
    choice and a hash of its rows: their sum, weighted by random numbers."""
    refs = pivots(count)
    weight = np.random.default_rng(65).integers(0, 1 << 64, (segments, count), np.uint64)
    rows = np.empty((segments, len(fps)), np.uint64)
    for k, m in enumerate(segment_masks(segments)):
        rows[k] = (np.bitwise_count((fps[:, None] ^ refs) & np.uint64(m)).astype(np.uint64) * weight[k]).sum(axis=1, dtype=np.uint64)
    out = [rows[list(own)].sum(axis=0, dtype=np.uint64) + np.uint64(k) for k, own in enumerate(combinations(range(segments), segments - radius))]
    return np.stack(out, axis=1)


def _within(i, j, a, b, radius: int):
    """The index pairs whose largest coordinate difference between the tables a and b is at most ``radius``, looked at
    four references at a time."""
    for k in range(0, a.shape[1], 4):
        if not len(i):
            break
        keep = (np.abs(a[i, k : k + 4] - b[j, k : k + 4]) <= radius).all(axis=1)
        i, j = i[keep], j[keep]
    return i, j


def near_pairs(left: np.ndarray, right: np.ndarray, refs: np.ndarray, radius: int = RADIUS):
    """Index pairs within ``radius`` bits: both sides are sorted by their distance to the first reference, partners
    lie in a window of it, pairs whose largest coordinate difference is over ``radius`` are discarded, the rest
    verified. Yields blocks of (i, j, distance)."""
    a, b = distance_table(left, refs), distance_table(right, refs)
    order_a, order_b = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    first_b = b[order_b, 0]
    low = np.searchsorted(first_b, a[order_a, 0] - radius, "left")
    high = np.searchsorted(first_b, a[order_a, 0] + radius, "right")
    step = 256
    for at in range(0, len(order_a), step):
        mine = order_a[at : at + step]
        others = order_b[low[at] : high[min(at + step, len(order_a)) - 1]]
        if not len(others):
            continue
        i, j = np.nonzero(np.abs(a[mine, 0][:, None] - b[others, 0][None, :]) <= radius)
        i, j = _within(mine[i], others[j], a, b, radius)
        if len(i):
            d = np.bitwise_count(left[i] ^ right[j])
            keep = d <= radius
            yield i[keep], j[keep], d[keep]


def near_neighbours(fps: np.ndarray, group: np.ndarray, own: np.ndarray, mixed: np.ndarray, refs: np.ndarray, radius: int = RADIUS):
    """Index pairs within ``radius`` bits of rows of one ``group`` (ascending), by the same steps as near_pairs, over many
    small groups at once. In ``mixed`` groups only rows of different ``own`` meet. Yields (i, j)."""
    table, lag = distance_table(fps, refs), 1
    at = np.arange(len(fps))
    while len(at):
        at = at[at < len(fps) - lag]
        at = at[group[at] == group[at + lag]]
        i = at[~mixed[at] | (own[at] != own[at + lag])]
        i, j = _within(i, i + lag, table, table, radius)
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        yield i[keep], j[keep]
        lag += 1


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning_links(fps: np.ndarray, half: int, refs: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``radius`` between ``fps[:half]`` and ``fps[half:]``, or, where
    ``half`` is 0, of all pairs. Values are signed longs."""
    parent, out = list(range(len(fps))), []
    for i, j, _ in near_pairs(fps[:half] if half else fps, fps[half:], refs, radius):
        for x, y in zip(i.tolist(), (j + half).tolist()):
            p, q = _find(parent, x), _find(parent, y)
            if p != q:
                parent[p] = q
                out.append((_signed(int(fps[x])), _signed(int(fps[y]))))
    return out


def links(distinct: DataFrame, work: Workspace, radius: int = RADIUS, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between different fingerprints that join all pairs within ``radius`` bits.

    ``distinct`` has one row ``fp`` for each different fingerprint. Each is dealt by its pivot keys, and only
    fingerprints that share one are candidates. Their distances to the references over all 64 bits discard pairs by the
    largest coordinate difference, and survivors are verified. Of the pairs found in a group of more than SMALL
    fingerprints a spanning forest is returned: components are the same and a dense group of g fingerprints gives about
    g links, not g * g / 2.

    A key held by more than ``block`` fingerprints is cut into s blocks by hash, and each pair of blocks is a group of
    its own: no key is gathered whole and no pair is left out. The number of segments and of tasks follows the number
    of fingerprints.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    segments = segments or segments_for(count, radius)

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = pivot_keys(fps.view(np.uint64), segments, radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fps, keys.shape[1])), pa.array(keys.ravel().view(np.int64))], ["fp", "key"])

    keyed = distinct.select("fp").mapInArrow(deal, "fp long, key long")
    sizes = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("s"))
    # written, as below: a join of two plain shuffles, of which AQE may split a large key
    keyed = keyed.join(work.save(sizes, "sizes"), "key")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("s")).cast("int")
    # a block meets every block, itself too
    mates = F.when(F.col("s") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("s") - 1))
    dealt = keyed.withColumn("own", own).withColumn("mate", F.explode(mates))
    deal_by = ["key", "low", "high"]
    dealt = dealt.select("fp", "own", "key", F.least("own", "mate").alias("low"), F.greatest("own", "mate").alias("high"))
    parts = tasks_for(spark, count * comb(segments, radius), TASK_ROWS)
    dealt = dealt.repartition(parts, *deal_by).sortWithinPartitions(*deal_by, "own", "fp")

    def settle(rows, refs):
        fp, own, *by = rows
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in by], axis=0)) + 1
        starts = np.concatenate(([0], cuts))
        size = np.diff(np.append(starts, len(fp)))
        group, mixed, out = np.repeat(np.arange(len(starts)), size), by[1] != by[2], []
        small = np.flatnonzero(((size > 1) & (size <= SMALL))[group])
        for i, j in near_neighbours(fp[small], group[small], own[small], mixed[small], refs, radius):
            out.append(np.stack([fp[small[i]], fp[small[j]]]).view(np.int64))
        for g in np.flatnonzero(size > SMALL).tolist():
            a, b = int(starts[g]), int(starts[g] + size[g])
            half = int(np.searchsorted(own[a:b], by[2][a])) if mixed[a] else 0
            if half < b - a:
                found = spanning_links(fp[a:b], half, refs, radius)
                out.append(np.array(found, np.int64).reshape(-1, 2).T)
        both = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches):
        refs, kept = pivots(), None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if kept is None else [np.concatenate(x) for x in zip(kept, rows)]
            if not len(rows[0]):
                continue
            same = np.all([x == x[-1] for x in rows[2:]], axis=0)
            last = int(np.argmax(same))
            if last:
                yield settle([x[:last] for x in rows], refs)
            kept = [x[last:].copy() for x in rows]
        if kept is not None and len(kept[0]):
            yield settle(kept, refs)

    return dealt.mapInArrow(run, "a long, b long")


def _by_bits(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, segments: int | None) -> DataFrame:
    """``doc_id, h, fp, part, component_id`` of each row."""
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.save(fingerprints(docs, id_col, text_col, words), "prints")
    groups = work.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    found = work.save(links(groups.select("fp"), work, radius, segments).distinct(), "links")
    parts = connected_components(found, work).select(F.col("node").alias("fp"), "component")
    return prints.join(_named(groups, parts, "fp", work), "fp")


def _named(groups: DataFrame, parts: DataFrame, key: str, work: Workspace) -> DataFrame:
    """``key, part, component_id``: the component of each group (``key, least``) and its smallest id."""
    groups = groups.join(parts, key, "left").withColumn("part", F.coalesce("component", key))
    names = work.save(groups.groupBy("part").agg(F.min("least").alias("component_id")), "names")
    return work.save(groups.join(names, "part").select(key, "part", "component_id"), "named")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, segments: int | None = None
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Documents link where their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest
    doc_id reachable over links, the document itself included. Words are runs of other characters than ASCII white
    space, A-Z lower-cased; a text of fewer than ``words`` words is one shingle; null, empty and blank texts have
    fingerprint zero and are linked like any other. A null id gets its component's id but never names one (a
    component of null ids has null). Repeated rows are returned as often as they occur. An empty table gives no
    rows. Other columns are ignored.

    Copies collapse to one row per fingerprint before any search, so a group of copies costs what one document
    does. Fingerprints, ids and links are shuffled, never texts.
    """
    found = _by_bits(docs, id_col, text_col, words, radius, segments)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _by_shingles(docs: DataFrame, id_col: str, text_col: str, lags: int, sample: int) -> DataFrame:
    """``doc_id, h, part, component_id`` of each row."""
    work = Workspace(docs.sparkSession, "similar")
    rows = _rows(docs, id_col, text_col)
    common = docs.sparkSession.sparkContext.broadcast(sets.common_shingles(rows, sample))
    prints = work.save(sets.shingle_prints(rows, common, bits_of), "prints")
    groups = work.save(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n")), "groups")

    # candidates by fingerprint: of one, or linked by pivot tables
    first = work.save(groups.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "first")
    same = groups.join(first, "fp").select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("first.node").alias("y"), F.col("first.n").alias("ny"))
    near = work.save(links(first.select("fp"), work).distinct(), "links")
    for side, name in (("a", "x"), ("b", "y")):
        ends = first.select(F.col("fp").alias(side), F.col("first.node").alias(name), F.col("first.n").alias(f"n{name}"))
        near = near.join(ends, side)
    both = same.unionByName(near.select("x", "nx", "y", "ny")).where("x <> y and 5 * least(nx, ny) >= 4 * greatest(nx, ny)")
    both = work.save(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") + F.col("ny")).alias("n")), "by_bits")

    # candidates by rare shingles
    dealt = prints.where("prefix is not null").select(F.explode("prefix").alias("tok"), "n", "node")
    many = prints.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("s")).first()["s"]
    met = work.save(sets.by_shingle(dealt, sets.meet(lags), many), "met")
    paired = both.withColumn("tok", F.lit(0).cast("long")).unionByName(met.where("b is not null"))
    involved = met.select(F.col("a").alias("node")).unionByName(paired.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sketches = prints.where("sketch is not null").select("node", "sketch").join(involved, "node", "left_semi").dropDuplicates(["node"])
    sketches = work.save(sketches, "sketches")
    found = sets.verified(rows, prints, sketches, paired.where(F.col("tok") <= lags).select("a", "b", "n"), work, "near")
    parts = connected_components(found, work, "cc")
    # of pairs further apart those that are not joined yet
    far = work.save(paired.where(F.col("tok") > lags).select("a", "b", "n").distinct(), "far")
    if not far.isEmpty():
        for side in ("a", "b"):
            far = far.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
        far = far.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "n")
        found = joined(parts).unionByName(sets.verified(rows, prints, sketches, far, work, "far"))
        parts = connected_components(found, work, "fc")
    wide = met.where("b is null")
    if not wide.isEmpty():
        held = wide.select("tok", "n", F.col("a").alias("node")).join(parts, "node", "left")
        held = held.select("tok", "n", "node", F.coalesce("component", "node").alias("part")).join(sketches, "node")
        rest = sets.by_shingle(held.select("tok", "n", "node", "part", "sketch"), sets.meet_rest, 16 * wide.count()).select("a", "b", "n")
        found = joined(parts).unionByName(sets.verified(rows, prints, None, rest, work, "rest"))
        parts = connected_components(found, work, "all")
    return prints.select("doc_id", "h", "node").join(_named(groups.select("node", "least"), parts.select("node", "component"), "node", work), "node")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lags: int = sets.LAGS, sample: int = sets.SAMPLE) -> DataFrame:
    """``doc_id, component_id`` for each row of ``docs``.

    Documents link where the sets of their shingles of five words have a Jaccard similarity of 0.8 or more;
    ``component_id`` is the smallest doc_id reachable over links. Words, nulls, null ids, repeated rows and empty tables
    are those of :func:`near_duplicates`; texts without words are alike.

    Pairs whose fingerprints the pivot tables link are candidates, and shingles verify them. But two sets with 0.8 in
    common differ in ten bits on average, so fingerprints alone would lose most links: other candidates are pairs that
    share a rare shingle. Similar sets share one among the first fifth in any order, so each set is dealt by these,
    rare ones first, and no similar pair is left out but those joined by others. Of a shingle with many holders, near
    ones meet first, then some further apart and then all others, each time those that are not joined yet. Equal sets are one; texts are never shuffled by shingle.
    """
    return _by_shingles(docs, id_col, text_col, lags, sample).select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, segments: int | None = None) -> DataFrame:
    """The rows of ``docs`` with one for each component of :func:`near_duplicates`: see :func:`keep_least`."""
    return keep_least(docs, _by_bits(docs, id_col, text_col, words, radius, segments), id_col, text_col)


def keep_similar_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lags: int = sets.LAGS, sample: int = sets.SAMPLE) -> DataFrame:
    """The rows of ``docs`` with one for each component of :func:`similar_documents`: see :func:`keep_least`."""
    return keep_least(docs, _by_shingles(docs, id_col, text_col, lags, sample), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` for each ``part`` of ``found`` (``doc_id, h, part``): that with the smallest id, a null id last;
    of rows with one id that whose text has the smallest hash, and of rows with one id and text any one. Ids need not
    be unique. Columns stay the same, whatever their names."""
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")
    i, h, k = free_names(docs, "id", "hash", "key")
    keep = found.groupBy("part").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias(i), F.col("m.h").alias(h))
    rows = docs.withColumn(k, F.xxhash64(F.col(text_col).cast("string")))
    rows = rows.join(keep, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(k) == F.col(h)), "left_semi")
    return rows.dropDuplicates([id_col, k]).select(*docs.columns)
