"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free_names

#: Characters in a q-gram and edits allowed per character of an item (below 1 / Q, so that the lemma's bound holds).
Q, EDIT_RATE = 12, 0.05
#: Characters of items that one pass over the documents looks for, at 20 bytes each in every worker; more items are
#: looked for in several passes.
PASS_CHARS = 3_000_000
#: Hits of q-grams held at a time.
AT_ONCE = 4_000_000
_MIX = 0x9E3779B97F4A7C15
_TABLE_BITS = 22


def _word_table() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x10000)], bool)


_IS_WORD = _word_table()


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased text with each run of other characters than letters and digits as one space,
    none at the ends; and the place of each in the lower-cased text."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _IS_WORD[np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() > 0xFFFF:
        far = np.flatnonzero(codes > 0xFFFF)
        word[far] = [chr(c).isalnum() for c in codes[far].tolist()]
    before = np.concatenate(([False], word[:-1])) if len(word) else word
    at = np.flatnonzero(word | before)
    out = np.where(word[at], codes[at], 32).astype(np.uint32)
    if len(out) and out[-1] == 32:
        at, out = at[:-1], out[:-1]
    return out, at


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each window of q code points. Windows of doubled length are built from two halves."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    part, length = codes.astype(np.uint64), 1
    done, have = None, 0
    need = q
    while need:
        if need & 1:
            if done is None:
                done, have = part, length
            else:
                n = len(codes) - have - length + 1
                done = done[:n] * np.uint64(pow(_MIX, length, 1 << 64)) + part[have : have + n]
                have += length
        need >>= 1
        if need:
            n = len(part) - length
            part = part[:n] * np.uint64(pow(_MIX, length, 1 << 64)) + part[length : length + n]
            length *= 2
    done = done[: len(codes) - q + 1]
    return done * np.uint64(_MIX) ^ (done >> np.uint64(29))


@dataclass
class Index:
    """The items of a pass. ``order``-ed q-gram hashes with their item and place, and a table of hash prefixes."""

    ids: list
    codes: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    table: np.ndarray
    q: int
    short: dict[int, dict[bytes, int]]
    short_ids: list


def build_index(items: list[tuple], q: int = Q, rate: float = EDIT_RATE, short_items: bool = False) -> Index:
    """Items shorter than q characters after normalisation are left out or, with ``short_items``, kept apart. The edit
    budget is rate * length, lowered where the lemma would ask for no shared q-gram."""
    rows = [(i, normalise(t)[0]) for i, t in items]
    few = [(i, c) for i, c in rows if 0 < len(c) < q] if short_items else []
    short: dict[int, dict[bytes, int]] = {}
    for k, (_, c) in enumerate(few):
        short.setdefault(len(c), {})[c.tobytes()] = k
    rows = [(i, c) for i, c in rows if len(c) >= q]
    lengths = np.array([len(c) for _, c in rows], np.int64)
    edits = np.minimum((lengths * rate).astype(np.int64), (lengths - q) // q)
    need = lengths - q + 1 - edits * q
    hashes = [gram_hashes(c, q) for _, c in rows]
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    item = np.repeat(np.arange(len(rows), dtype=np.int32), [len(h) for h in hashes])[order] if rows else np.empty(0, np.int32)
    pos = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])[order] if rows else np.empty(0, np.int32)
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[flat >> np.uint64(64 - _TABLE_BITS)] = True
    return Index([i for i, _ in rows], [c for _, c in rows], edits, need, flat[order], item, pos, table, q, short, [i for i, _ in few])


def align(item: np.ndarray, region: np.ndarray, budget: int, low: int, high: int) -> int | None:
    """Fewest edits that turn ``item`` into a piece of ``region``, over alignments on diagonals low..high of the
    region; None if above the budget. Each row of the band is one step of array operations."""
    width = high - low + 1
    steps = np.arange(width)
    far = len(item) + len(region) + 1
    place = low + steps  # region characters used before item row 0
    row = np.where((place >= 0) & (place <= len(region)), 0, far)
    for r, c in enumerate(item):
        at = low + r + steps  # the region character on this diagonal
        inside = (at >= 0) & (at < len(region))
        same = np.where(inside, region[np.clip(at, 0, len(region) - 1)] == c, False) if len(region) else inside
        new = np.where(inside, row + ~same, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        edge = at + 1
        new = np.where((edge < 0) | (edge > len(region)), far, new)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > budget:
            return None
    best = int(row.min())
    return best if best <= budget else None


def find_items(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(item number, edits, start, end) of each item in the text, start and end in the lower-cased text."""
    codes, at = normalise(text)
    if len(codes) < index.q or not len(index.hashes):
        return []
    hashes = gram_hashes(codes, index.q)
    place = np.flatnonzero(index.table[hashes >> np.uint64(64 - _TABLE_BITS)])
    if not len(place):
        return []
    low = np.searchsorted(index.hashes, hashes[place], "left")
    many = np.searchsorted(index.hashes, hashes[place], "right") - low
    place, low, many = place[many > 0], low[many > 0], many[many > 0]
    if not len(place):
        return []
    found: dict[int, tuple[int, int, int, int]] = {}
    if many.sum() <= AT_ONCE:
        _search(codes, at, *_hits(place, low, many, index.item, index.pos), index, found)
        return sorted(found.values())
    # too many to hold: items are searched in groups, so that each item's hits are counted together
    hits = np.zeros(len(index.codes), np.int64)
    for a, b in _runs(many):
        hits += np.bincount(_hits(place[a:b], low[a:b], many[a:b], index.item, index.pos)[0], minlength=len(hits))
    able = np.flatnonzero(hits >= index.need)
    for a, b in _runs(hits[able]):
        own = np.zeros(len(hits), bool)
        own[able[a:b]] = True
        held = np.flatnonzero(own[index.item])
        grams, item, pos = index.hashes[held], index.item[held], index.pos[held]
        low = np.searchsorted(grams, hashes[place], "left")
        many = np.searchsorted(grams, hashes[place], "right") - low
        if many.sum() <= AT_ONCE:
            _search(codes, at, *_hits(place, low, many, item, pos), index, found)
        else:
            number = int(able[a])
            _verify(codes, at, _bands_of_one(number, place, low, many, pos, index), index, found)
    return sorted(found.values())


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of places that add up to at most AT_ONCE each, or hold one place."""
    total, start, out = np.cumsum(sizes), 0, []
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + AT_ONCE, "right")))
        out.append((start, stop))
        start = stop
    return out


def _hits(place, low, many, item, pos):
    """Item, place in the item and place in the document of each hit."""
    hit = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    return item[hit], pos[hit], np.repeat(place, many)


def _bands_of_one(number: int, place, low, many, pos, index) -> list[tuple[int, int]]:
    """The bands of an item that reach its bound, its hits added up in pieces: a mark for each band and place."""
    step = int(index.edits[number]) + 1
    size = len(index.codes[number]) - index.q + 1
    least = (int(place[0]) - size + 1) // step
    seen = np.zeros((int(place[-1]) // step - least + 3, size), bool)  # an empty band at both ends
    for a, b in _runs(many):
        _, own, doc = _hits(place[a:b], low[a:b], many[a:b], pos, pos)
        seen[(doc - own) // step - least + 1, own] = True
    return [(number, b + least - 1) for b in range(len(seen) - 1) if np.count_nonzero(seen[b] | seen[b + 1]) >= index.need[number]]


def _search(codes, at, item, pos, doc, index, found) -> None:
    step = index.edits[item] + 1
    band = (doc - pos) // step
    counted = []
    for shift in (0, -1):  # bands overlap by half: each hit counts in two
        # one count for each item, band and place in the item
        key = np.unique(np.stack([item, band + shift, pos]), axis=1)
        cuts = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1
        starts = np.concatenate(([0], cuts)) if key.shape[1] else cuts
        counts = np.diff(np.append(starts, key.shape[1]))
        counted.append({(int(key[0, s]), int(key[1, s])): key[2, s : s + c] for s, c in zip(starts, counts)})
    reached = []
    for number, b in sorted(counted[0].keys() | counted[1].keys()):
        parts = [x[(number, b)] for x in counted if (number, b) in x]
        shared = len(parts[0]) if len(parts) == 1 else len(np.union1d(*parts))
        if shared >= index.need[number]:
            reached.append((number, b))
    _verify(codes, at, reached, index, found)


def _verify(codes, at, reached, index, found) -> None:
    """Aligns the items in the bands (item number, band) that reach the bound, and keeps the best of each item."""
    for number, b in reached:
        if number in found and found[number][1] == 0:
            continue
        mine, budget = index.codes[number], int(index.edits[number])
        width = budget + 1
        begin = max(0, b * width - budget)
        end = min(len(codes), (b + 2) * width + len(mine) + budget)
        region = codes[begin:end]
        whole = region.tobytes().find(mine.tobytes())
        while whole >= 0 and whole % 4:
            whole = region.tobytes().find(mine.tobytes(), whole + 1)
        edits = 0 if whole >= 0 else align(mine, region, budget, b * width - begin - budget, (b + 2) * width - 1 - begin + budget)
        if edits is not None and (number not in found or edits < found[number][1]):
            first_char = begin + whole // 4 if whole >= 0 else begin
            last_char = first_char + len(mine) if whole >= 0 else end
            found[number] = (number, edits, int(at[first_char]), int(at[min(last_char, len(at)) - 1]) + 1)


def find_short(text: str | None, short: dict[int, dict[bytes, int]]) -> list[tuple[int, int, int, int]]:
    """Like find_items for items too short for q-grams (by length: code points and item number): whole words, verbatim."""
    codes, at = normalise(text)
    found = []
    for size, items in short.items():
        if len(codes) < size:
            continue
        # the text's windows of this length that begin and end with a word
        border = np.concatenate(([True], codes == 32, [True]))
        for k in np.flatnonzero(border[: len(codes) - size + 1] & border[size + 1 :]).tolist():
            number = items.get(codes[k : k + size].tobytes())
            if number is not None and number not in {f[0] for f in found}:
                found.append((number, 0, int(at[k]), int(at[k + size - 1]) + 1))
    return sorted(found)


def _passes(items: DataFrame, pass_chars: int) -> Iterator[tuple[list[tuple], int]]:
    """One pass after the other, as (ids, text) of each different normalised text, and how many passes there are."""
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-chars // pass_chars))
    if passes > 1:
        items = Workspace(items.sparkSession, "items").save(items.withColumn("pass", F.pmod(F.xxhash64("text"), F.lit(passes))), "items")
    for k in range(passes):
        rows = items if passes == 1 else items.where(F.col("pass") == k)
        rows = sorted(((r["item_id"], r["text"]) for r in rows.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        # each different text is searched once, for all its ids
        texts: dict[bytes, tuple[list, str]] = {}
        for i, t in rows:
            texts.setdefault(normalise(t)[0].tobytes(), ([], t))[0].append(i)
        yield list(texts.values()), passes


def _found(
    docs: DataFrame, items: DataFrame, name: str, *, text_col: str, item_id_col: str, item_text_col: str, q: int, rate: float, pass_chars: int, short_items: bool
) -> DataFrame:
    """``docs`` with the matches of all items in column ``name``."""
    spark = docs.sparkSession
    kind = items.schema[item_id_col].dataType
    spans = f"array<struct<item_id:{kind.simpleString()},edits:int,start:int,end:int>>"
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    work = rows = None
    names, found = free_names(docs, "row", "found"), []
    for k, (texts, passes) in enumerate(_passes(items, pass_chars)):
        shared = spark.sparkContext.broadcast(build_index(texts, q, rate, short_items))
        if passes == 1:
            return docs.withColumn(name, F.array_sort(_search_udf(shared, spans, kind)(F.col(text_col).cast("string"))))
        # each pass is a job of its own, so a worker holds one index at a time
        if work is None:
            work = Workspace(spark, "contamination")
            rows = work.save(docs.withColumn(names[0], F.monotonically_increasing_id()), "rows")
        one = rows.select(names[0], _search_udf(shared, spans, kind)(F.col(text_col).cast("string")).alias(names[1]))
        found.append(work.save(one.where(F.size(names[1]) > 0), f"pass_{k}"))
        shared.destroy()
    both = reduce(DataFrame.unionByName, found).groupBy(F.col(names[0]).alias("row")).agg(F.array_sort(F.flatten(F.collect_list(names[1]))).alias("found"))
    both = work.save(both, "found").withColumnsRenamed({"row": names[0], "found": names[1]})
    out = rows.drop(*[c for c in [name] if c in rows.columns]).join(both, names[0], "left")
    return out.withColumn(name, F.coalesce(names[1], F.array().cast(spans))).drop(*names)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    q: int = Q,
    rate: float = EDIT_RATE,
    pass_chars: int = PASS_CHARS,
    short_items: bool = False,
) -> DataFrame:
    """``docs`` with ``contaminated`` and ``matches``, an array of (item_id, edits, start, end) by item; columns of these
    names are replaced.

    A document holds an item where, after lower-casing and with runs of other characters than letters and digits as
    one space, a piece of it is within the item's edit budget: rate * length edits, and for items of under 24
    characters as many as the lemma has room for. By the q-gram lemma such a piece shares at least length - q + 1 - q *
    edits q-grams with the item inside one band of diagonals; bands that reach the bound are aligned within the band.
    ``start`` and ``end`` are places in the lower-cased text, exact for verbatim matches and those of the aligned region
    otherwise.

    Null and empty texts and items match nothing. Items shorter than q characters, which are a word or two, match
    nothing either, or, with ``short_items``, wherever they stand verbatim as whole words. Items of one text are all
    reported; null item ids are reported as null. Rows are searched one by one over their whole text, so repeated
    rows repeat their result; an empty table gives no rows. Items are collected and broadcast in passes of
    ``pass_chars`` characters, measured first. One pass needs no shuffle; more are jobs of their own over numbered
    rows, whose matches are joined.
    """
    how = dict(text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, q=q, rate=rate, pass_chars=pass_chars, short_items=short_items)
    out = _found(docs, items, "matches", **how)
    return out.withColumn("contaminated", F.size("matches") > 0)


def _search_udf(shared, spans: str, id_type):
    from pyspark.sql.pandas.types import to_arrow_type

    inner = pa.struct([("item_id", to_arrow_type(id_type)), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(spans)
    def search(texts: pa.Array) -> pa.Array:
        index = shared.value
        rows = []
        for t in texts:
            t = t.as_py()
            found = [(index.ids[n], e, a, b) for n, e, a, b in find_items(t, index)]
            found += [(index.short_ids[n], e, a, b) for n, e, a, b in find_short(t, index.short)] if index.short else []
            rows.append([{"item_id": i, "edits": e, "start": a, "end": b} for ids, e, a, b in found for i in ids])
        return pa.array(rows, pa.list_(inner))

    return search


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item (see contamination); columns keep their names and values, whatever the
    names."""
    how = dict(text_col="text", item_id_col="item_id", item_text_col="text", q=Q, rate=EDIT_RATE, pass_chars=PASS_CHARS, short_items=False) | how
    (name,) = free_names(docs, "matches")
    return _found(docs, items, name, **how).where(F.size(name) == 0).select(*docs.columns)
