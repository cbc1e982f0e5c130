"""Token-ID output: documents as token ids in a compact file format, and the reader."""

from __future__ import annotations

import json
import struct
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, release, tasks_for
from .mixing_coder import BLOCK, decode_block, encode_block, lane_lengths

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Tokens in a segment, the unit of writing and reading: whole documents, cut into blocks.
SEGMENT = 2_000_000
#: Bytes of text that one task sorts and encodes.
TASK_BYTES = 64 << 20
#: Bytes of text that are encoded at a time.
PIECE_BYTES = 2 << 20
MAGIC = b"ATOK"
_HEAD = struct.Struct("<4sHIQQII")  # magic, version, alphabet, tokens, bytes of the table, its crc32, blocks
_BLOCK = struct.Struct("<III")  # tokens, 32-bit words, crc32 of the ids as 32-bit integers and the coded bytes
_TAIL = ".,!?;:"
#: The steps of a vocabulary whose pieces between white space can be encoded apart, and words by themselves.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = {"NFC", "Replace", "Lowercase"}
#: Letters that NFC leaves as they are and that lower-case to one letter, which U+0130 does not.
_LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next free
    one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Encoder:
    """The tokenizers library over Arrow batches.

    Where the vocabulary's normaliser and splitter are known never to join across white space, each different piece
    between ASCII white space is encoded once and kept, in bounded memory; a word of Latin letters, alone or before
    punctuation marks, goes straight to the library's byte-pair model, since normalisation leaves it a word. Other
    letters, which NFC may change or which may lower-case to several, are left to the whole of the library, as are all
    texts of a vocabulary of other steps. Beyond ``limit`` pieces only those met again since the last time are kept. A
    test holds the result against the encoding of whole texts.
    """

    def __init__(self, path: str, limit: int = 320_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.alphabet = max(self.tokenizer.get_vocab().values()) + 1
        self.kind = np.dtype("<u2" if self.alphabet <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_piece = (
            set(steps) <= _STEPS
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": _SPLIT}
            and not cuts[1]["add_prefix_space"]
            and spec["model"]["type"] == "BPE"
        )
        self.lower = "Lowercase" in steps
        self.letters = _byte_letters()
        self.number = {"": 0}  # of each piece that is kept, in their order
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.met = np.zeros(1024, bool)  # pieces met again
        self.store, self.used = np.empty(4096, self.kind), 0

    def _forget(self) -> None:
        """Drops the pieces not met again, and the later ones where half of the limit were."""
        kept = np.flatnonzero(self.met[: len(self.number)])
        kept = np.append(0, kept[kept > 0][: self.limit // 2])
        self.store, ends = _gather(self.store, self.first[kept], self.size[kept])
        self.size = self.size[kept]
        self.first, self.used = ends - self.size, len(self.store)
        self.met = np.zeros(len(kept), bool)
        names = list(self.number)
        self.number = {names[i]: k for k, i in enumerate(kept.tolist())}

    def _keep(self, pieces: list[str], ids: list[list[int]]) -> None:
        at, many = len(self.number), len(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, many)
        total = int(sizes.sum())
        if at + many > len(self.first):
            room = 2 * (at + many)
            self.first, self.size, self.met = np.resize(self.first, room), np.resize(self.size, room), np.resize(self.met, room)
        if self.used + total > len(self.store):
            self.store = np.resize(self.store, 2 * (self.used + total))
        self.first[at : at + many] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + many] = sizes
        self.met[at : at + many] = False
        self.store[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), self.kind, total)
        self.used += total
        self.number.update(zip(pieces, range(at, at + many)))

    def _numbers(self, pieces: list[str], encode) -> np.ndarray:
        get = self.number.get
        out = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        self.met[out[out >= 0]] = True
        if len(out) and out.min() < 0:
            fresh = list(dict.fromkeys(pieces[i] for i in np.flatnonzero(out < 0).tolist()))
            self._keep(fresh, encode(fresh))
            out = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        return out

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of words of Latin letters, already in the vocabulary's case."""
        tokens = self.model.tokenize
        return [[t.id for t in tokens(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))] for w in words]

    def _any(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _parts(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of each different piece's word, or of itself, and of the punctuation behind the word."""
        body = pc.ascii_rtrim(pieces, characters=_TAIL)
        latin = pc.match_substring_regex(body, _LATIN)
        out = np.zeros((len(pieces), 2), np.int64)
        at = np.flatnonzero(latin.to_numpy(zero_copy_only=False))
        words = body.filter(latin)
        words = (pc.utf8_lower(words) if self.lower else words).dictionary_encode()
        out[at, 0] = self._numbers(_strings(words.dictionary), self._words)[words.indices.to_numpy(zero_copy_only=False)]
        behind = pc.subtract(pc.binary_length(pieces), pc.binary_length(body)).to_numpy()
        behind = np.where(latin.to_numpy(zero_copy_only=False), behind, 0)
        for many in np.unique(behind[behind > 0]).tolist():
            at = np.flatnonzero(behind == many)
            tails = pc.utf8_slice_codeunits(pieces.take(pa.array(at)), -many).dictionary_encode()
            out[at, 1] = self._numbers(_strings(tails.dictionary), self._any)[tails.indices.to_numpy(zero_copy_only=False)]
        whole = pc.invert(latin)
        out[np.flatnonzero(whole.to_numpy(zero_copy_only=False)), 0] = self._numbers(_strings(pieces.filter(whole)), self._any)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order (null counts as empty), and the number of each text's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_piece:
            ids = self._any(texts.to_pylist())
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), self.kind, int(counts.sum())), counts
        if len(self.number) > self.limit:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        parts = self._parts(flat.dictionary)
        store, ends = _gather(self.store, self.first[parts].ravel(), self.size[parts].ravel())
        ends = ends[1::2]  # of both parts of each different piece
        sizes = np.diff(ends, prepend=0)
        piece = flat.indices.to_numpy(zero_copy_only=False)
        ids, ends = _gather(store, (ends - sizes)[piece], sizes[piece])
        offsets = split.offsets.to_numpy()
        total = np.concatenate(([0], ends))
        return ids, np.diff(total[offsets - offsets[0]])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _gather(store: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``store`` one after the other, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return store[np.repeat(first - (ends - size), size) + np.arange(total)], ends


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_segment(ids: np.ndarray, table: pa.RecordBatch, alphabet: int, block: int = BLOCK) -> bytes:
    """A segment: header, table of documents (``doc_id`` of any type, ``n_tokens``) as an Arrow stream, then blocks, each
    coded from an empty model with its checksum: the words of its lanes in 16 bits each, and the words."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    named = sink.getvalue().to_pybytes()
    blocks = max(0, -(-len(ids) // block))
    out = [_HEAD.pack(MAGIC, 2, alphabet, len(ids), len(named), zlib.crc32(named), blocks), named]
    for at in range(0, len(ids), block):
        own = ids[at : at + block]
        used, words = encode_block(own, alphabet)
        coded = used.astype("<u2").tobytes() + words.astype("<u4").tobytes()
        out += [_BLOCK.pack(len(own), len(words), zlib.crc32(coded, zlib.crc32(own.astype("<u4").tobytes()))), coded]
    return b"".join(out)


def read_segment(data: bytes) -> tuple[np.ndarray, pa.RecordBatch]:
    """Ids and table of a segment; ValueError where it is cut short or a checksum does not fit."""
    try:
        magic, version, alphabet, tokens, size, crc, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 2:
            raise ValueError("not a segment of version 2")
        at = _HEAD.size
        named = data[at : at + size]
        if zlib.crc32(named) != crc:
            raise ValueError("the table's checksum differs")
        at += size
        table = pa.ipc.open_stream(named).read_next_batch()
        parts = []
        for _ in range(blocks):
            n, many, crc = _BLOCK.unpack_from(data, at)
            at += _BLOCK.size
            lanes = len(lane_lengths(n))
            if at + 2 * lanes + 4 * many > len(data):
                raise ValueError("segment cut short")
            used = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
            if used.sum() != many:
                raise ValueError("a block's lanes differ")
            own = decode_block(used, np.frombuffer(data, "<u4", many, at + 2 * lanes), n, alphabet)
            if zlib.crc32(data[at : at + 2 * lanes + 4 * many], zlib.crc32(own.astype("<u4").tobytes())) != crc:
                raise ValueError("a block's checksum differs")
            parts.append(own)
            at += 2 * lanes + 4 * many
    except (struct.error, IndexError, pa.ArrowException) as e:
        raise ValueError(f"damaged segment: {e}") from e
    ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
    if len(ids) != tokens or (pc.sum(table.column(1)).as_py() or 0) != tokens:
        raise ValueError("token counts differ")
    return ids, table


def _slices(batch: pa.RecordBatch):
    """Rows with about PIECE_BYTES of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PIECE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_tokens(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, segment: int = SEGMENT
) -> None:
    """Writes the ids of all documents, each with ``end_id`` appended, into the folder ``path``.

    Documents are range-partitioned and sorted by id (null first), so partition after partition and segment after
    segment ids ascend; rows with one id follow each other by text. Ids may be of any type that can be sorted. A
    segment holds whole documents, about ``segment`` tokens of them, in one binary value whose layout is that of
    write_segment; segments are rows ``shard, part, data`` of Parquet files, committed by Spark in any store. A task
    holds one segment, or one document if that is longer; there are as many tasks as the texts' bytes ask for. Null
    texts are empty; repeated rows are written as often as they occur.
    """
    path_of = vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = tasks_for(docs.sparkSession, size, TASK_BYTES)
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        release()
        encoder, shard = _encoder(path_of), TaskContext.get().partitionId()
        held, keys, counts, size, part = [], [], [], 0, 0

        def emit():
            table = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(np.concatenate(counts), pa.int64())], ["doc_id", "n_tokens"])
            data = write_segment(np.concatenate(held), table, encoder.alphabet)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["shard", "part", "data"]
            )

        for batch in batches:
            for own in _slices(batch):
                ids, many = encoder.batch(own.column(1))
                # the end id goes behind each document's own ids
                ids = np.insert(ids, np.cumsum(many), end_id)
                held.append(ids.astype(np.int32))
                keys.append(own.column(0))
                counts.append(many + 1)
                size += len(ids)
                if size >= segment:
                    yield emit()
                    held, keys, counts, size, part = [], [], [], 0, part + 1
        if keys:
            yield emit()
        del held, keys, counts
        release()

    rows.mapInArrow(run, "shard int, part int, data binary").write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, *, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """The documents of ``path``, read from its segments: ``shard, part, pos, doc_id, n_tokens, ids_crc32, before``
    (tokens of the segment's documents before it), and with ``with_ids`` the ids. ``id_type`` is that of the documents
    written."""
    extra = ", ids array<int>" if with_ids else ""

    def run(batches):
        _encoder.cache_clear()  # what the worker has written is done
        release()
        for batch in batches:
            for shard, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids, table = read_segment(data.as_buffer().to_pybytes())
                counts = table.column(1).to_numpy()
                ends = np.cumsum(counts)
                view = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                n = len(counts)
                columns = [
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(n)),
                    table.column(0),
                    pa.array(counts),
                    pa.array(crcs, pa.int64()),
                    pa.array(ends - counts),
                ]
                names = ["shard", "part", "pos", "doc_id", "n_tokens", "ids_crc32", "before"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.schema("shard int, part int, data binary").parquet(path)
    return files.mapInArrow(run, f"shard int, part int, pos long, doc_id {id_type}, n_tokens long, ids_crc32 long, before long{extra}")


def token_output(docs: DataFrame, **how) -> DataFrame:
    """Writes ``docs`` as token files in the shared folder, reads them back and returns, for each row, ``doc_id,
    start`` (tokens of all documents before it), ``n_tokens`` and ``ids_crc32`` (of its ids as little-endian unsigned
    32-bit integers). See write_tokens for nulls, ties and empty tables.

    Starts add three running sums: inside a segment, over a shard's segments, over the shards; the last is over one
    row for each partition."""
    spark = docs.sparkSession
    work = Workspace(spark, "tokens")
    write_tokens(docs, work.path("files"), **how)
    kind = docs.schema[how.get("id_col", "doc_id")].dataType.simpleString()
    rows = work.save(read_tokens(spark, work.path("files"), id_type=kind), "read")
    parts = rows.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n"))
    shards = parts.groupBy("shard").agg(F.sum("n").alias("n"))
    ahead = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shards_before"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    parts = parts.withColumn("parts_before", inside).join(ahead, "shard")
    return rows.join(parts.drop("n"), ["shard", "part"]).select(
        "doc_id", (F.col("shards_before") + F.col("parts_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
