"""Sets of word shingles: pairs of a Jaccard similarity of at least 4/5, found by prefixes and verified. The part of the
SimHash operator that decides whether candidates are similar and finds those that fingerprints cannot show."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, release, tasks_for
from .components import stars

#: Words in a shingle. Two sets are similar where 5 * common >= 4 * joined, or size + size >= 9 * different.
WORDS = 5
#: Documents whose shingles are counted to find common ones, and the most of these that are kept.
SAMPLE, COMMON = 5_000, 200_000
#: Holders of a shingle are sorted by size; each meets so many before it, and those powers of two before it.
LAGS = 4
#: Ids up to this many are broadcast when texts are read again.
BROADCAST = 1_000_000
#: Shingles that one task holds.
TASK_ROWS = 8_000_000


def shingle_spans(text: str | None, words: int):
    """The text's words, A-Z lower-cased, joined by single spaces, and the places of its shingles in that."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = memoryview(b" ".join(found))
    if len(found) <= words:
        return joined, [(0, len(joined))] if found else []
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return joined, zip(starts[: 1 - words].tolist(), (ends[words - 1 :] - 1).tolist())


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's shingles, repeats included; none for a text without words."""
    joined, spans = shingle_spans(text, words)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of the text's different shingles."""
    return np.unique(shingle_hashes(text, words))


def node_of(own: np.ndarray) -> int:
    """The name of a set of shingles, a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of ``own`` in an order that all sets share: rare shingles by hash, then common ones by ``rank``. Two
    similar sets have one in both their prefixes, whatever the order."""
    size = len(own)
    if not size:
        return own
    need = size - (4 * size + 4) // 5 + 1
    at = np.minimum(np.searchsorted(common, own), max(0, len(common) - 1))
    held = common[at] == own if len(common) else np.zeros(size, bool)
    out = own[~held][:need]
    if len(out) < need:
        late = own[held]
        out = np.concatenate([out, late[np.argsort(rank[at[held]], kind="stable")][: need - len(out)]])
    return out


def sketch(own: np.ndarray) -> bytes:
    """The parity of the number of shingles with each remainder: as many bits differ between two sets as shingles do,
    or fewer. At least 256 bits and two for each shingle."""
    bits = 1 << max(8, int(2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


@F.arrow_udf(T.BooleanType())
def _possible(a: pa.Array, b: pa.Array, size: pa.Array) -> pa.Array:
    return pa.array([9 * least_difference(x.as_py(), y.as_py()) <= n.as_py() for x, y, n in zip(a, b, size)], pa.bool_())


def common_shingles(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several documents of a sample hold, and the rank of each by their number. They only order
    the shingles, so the sample changes the effort and never the result."""
    total = rows.count()

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) if found else np.empty(0, np.uint64)).view(np.int64))], ["tok"])

    picked = rows.select("text").sample(min(1.0, sample / max(1, total)), 42).mapInArrow(run, "tok long")
    many = picked.groupBy("tok").count().where("count > 2").orderBy(F.desc("count"), "tok").limit(COMMON).toPandas()
    own, count = many["tok"].to_numpy(np.int64).view(np.uint64), many["count"].to_numpy(np.int64)
    order = np.argsort(own)
    rank = np.empty(len(own), np.int64)
    rank[np.lexsort((own, count))] = np.arange(len(own))
    return own[order], rank[order]


def shingle_prints(rows: DataFrame, common, bits_of) -> DataFrame:
    """``doc_id, h, node, n, fp, sketch, prefix`` of rows ``doc_id, h, text``; ``fp`` is ``bits_of`` all shingles' hashes,
    ``sketch`` and ``prefix`` are null for sets met before in the same partition."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        order, seen = common.value, set()
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            out = [[], [], [], [], []]
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), WORDS)
                own = np.unique(hashes)
                node = node_of(own)
                first = node not in seen
                seen.add(node)
                values = (node, len(own), bits_of(hashes), sketch(own) if first else None, prefix(own, *order).view(np.int64) if first else None)
                for to, x in zip(out, values):
                    to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            names = ["doc_id", "h", "node", "n", "fp", "sketch", "prefix"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)], names)
        del seen
        release()

    return rows.mapInArrow(run, f"doc_id {kind}, h long, node long, n int, fp long, sketch binary, prefix array<long>")


def by_shingle(rows: DataFrame, settle, many: int) -> DataFrame:
    """``settle`` over whole groups of one ``tok``, the first column, sorted by ``n`` and ``node``; there are about ``many``
    rows."""
    rows = rows.repartition(tasks_for(rows.sparkSession, many, TASK_ROWS), "tok").sortWithinPartitions("tok", "n", "node")

    def run(batches):
        kept = None
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            own = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
            if len(own[0]):
                last = int(np.searchsorted(own[0], own[0][-1], "left"))
                if last:
                    yield from settle([x[:last] for x in own])
                kept = [x[last:].copy() for x in own]
        if kept is not None:
            yield from settle(kept)
        del kept
        release()

    return rows.mapInArrow(run, "a long, b long, n int, tok long")


def _pair_batch(a, b, size, tok=None) -> pa.RecordBatch:
    """Pairs, smaller node first, or, without ``b``, rows of a shingle's holders."""
    low, high = (pa.array(a), pa.nulls(len(a), pa.int64())) if b is None else map(pa.array, (np.minimum(a, b), np.maximum(a, b)))
    tok = pa.nulls(len(a), pa.int64()) if tok is None else pa.array(tok)
    return pa.RecordBatch.from_arrays([low, high, pa.array(size.astype(np.int32)), tok], ["a", "b", "n", "tok"])


def meet(lags: int):
    """Pairs of sets with a common prefix shingle, all of those up to ``lags`` places apart, with their distance for
    ``tok``; and the rows of groups that hold others (b null)."""

    def settle(rows):
        tok, n, node = rows
        fresh = np.append(True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1]))[: len(tok)]
        tok, n, node = tok[fresh], n[fresh].astype(np.int64), node[fresh]
        lag = 1
        while lag < len(tok):
            same = tok[lag:] == tok[:-lag]
            if not same.any():
                break
            at = np.flatnonzero(same & (5 * n[:-lag] >= 4 * n[lag:]))
            if len(at):
                yield _pair_batch(node[at], node[at + lag], n[at] + n[at + lag], np.full(len(at), lag))
            lag = lag + 1 if lag < lags else 1 << lag.bit_length()
        starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])[: len(tok)])
        many = np.diff(np.append(starts, len(tok)))
        wide = np.repeat(many > lags + 1, many)
        if wide.any():
            yield _pair_batch(node[wide], None, n[wide], tok[wide])

    return settle


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of ``size`` bytes, or of more, folded to it, as rows of 64-bit words."""
    out = np.empty((len(sketches), size), np.uint8)
    for k, one in enumerate(sketches):
        x = np.frombuffer(one, np.uint8)
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out.view(np.uint64)


def meet_rest(rows):
    """The pairs of a group that are not joined yet and whose sketches differ in few enough bits to be similar."""
    tok, n, node, part, sketch = rows
    starts = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])[: len(tok)])
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(tok)).tolist()):
        size, own, of, drawn = n[a:b].astype(np.int64), node[a:b], part[a:b], sketch[a:b].tolist()
        if (of == of[0]).all():
            continue
        width = np.array([len(x) for x in drawn])
        # similar sets are of sizes that differ by a quarter, so their sketches are of one length or one is twice the other
        at_width = {}
        for w in np.unique(width).tolist():
            held = np.flatnonzero((width == w) | (width == 2 * w))
            place = np.full(b - a, -1)
            place[held] = np.arange(len(held))
            at_width[w] = (place, _folded([drawn[k] for k in held.tolist()], w))
        last = np.searchsorted(4 * size, 5 * size, "right")  # partners behind each row
        for at in range(0, b - a, 64):
            x = np.arange(at, min(at + 64, b - a))
            y = np.arange(at, int(last[x].max()))
            i, j = np.nonzero((of[x][:, None] != of[y][None, :]) & (x[:, None] < y[None, :]) & (y[None, :] < last[x][:, None]))
            i, j = x[i], y[j]
            low = np.minimum(width[i], width[j])
            for w in np.unique(low).tolist():
                place, words = at_width[w]
                p, q = i[low == w], j[low == w]
                step = max(1, (8 << 20) // w)
                for k in range(0, len(p), step):
                    s, t = p[k : k + step], q[k : k + step]
                    different = np.bitwise_count(words[place[s]] ^ words[place[t]]).sum(axis=1, dtype=np.int64)
                    near = 9 * different <= size[s] + size[t]
                    if near.any():
                        yield _pair_batch(own[s[near]], own[t[near]], size[s[near]] + size[t[near]])


def verified(rows: DataFrame, prints: DataFrame, sketches: DataFrame | None, pairs: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``a, b``: links that join those of ``pairs`` (a, b, n) that are similar: ``sketches`` discard, where they have not
    yet, and shingles decide. Of the links of a dense group stars are left (see stars)."""
    pairs = pairs.distinct()
    if sketches is not None:
        for side in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}")), side)
        pairs = pairs.where(_possible("sa", "sb", "n")).select("a", "b", "n")
    pairs = work.save(pairs, f"{name}_possible")
    many = pairs.count()
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    one = F.min(F.struct("doc_id", "h")).alias("one")
    wanted = work.save(prints.join(nodes, "node").groupBy("node").agg(one).select(F.col("one.doc_id").alias("i"), F.col("one.h").alias("k")), f"{name}_ids")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(0)]
            nodes = pa.array([node_of(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "own"])

    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left_semi").select("text")
    sets = work.save(texts.mapInArrow(run, "node long, own array<long>").dropDuplicates(["node"]), f"{name}_sets")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("own").alias(f"o{side}")), side)
    both = F.size(F.array_intersect("oa", "ob"))
    return work.save(stars(pairs.where(5 * both >= 4 * (F.col("n") - both)), many), f"{name}_links")
