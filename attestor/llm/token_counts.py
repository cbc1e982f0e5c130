"""Token counts: whole documents encoded once, tokens attributed to sections by their character spans."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a token that crosses a section's end is counted: by its first or last character, by the section that holds
#: most of its characters (the earlier of two that hold as many), or split by characters.
RULES = ("first", "last", "most", "split")
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _encoding(path: str):
    """The encoder of a rank file and the byte length of each id; one per worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the whole text and the characters that each covers: from ``start`` up to ``end``. Tokens are runs of
    bytes; one that ends inside a character covers it."""
    encoding, sizes = _encoding(path)
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.cumsum(sizes[ids])
    if len(data) == len(text):
        return ids, ends - sizes[ids], ends
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    return ids, char[ends - sizes[ids]], char[ends - 1] + 1


def line_sections(text: str) -> np.ndarray:
    """Ends of the lines of a text, each with its line feed; an empty text is one empty section."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def attribute(start: np.ndarray, end: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section. ``ends`` are the sections' ends in order, each section beginning
    where the one before ends. A crossing token touches more than one section; it counts as crossing in the section
    of its first character."""
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, end - 1, "right")
    n, crossing = len(ends), np.bincount(first[first != last], minlength=len(ends))
    if rule == "first":
        return np.bincount(first, minlength=n).astype(np.float64), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(np.float64), crossing
    counts = np.bincount(first[first == last], minlength=n).astype(np.float64)
    begins = np.concatenate(([0], ends[:-1]))
    for k in np.flatnonzero(first != last):
        span = np.arange(first[k], last[k] + 1)
        part = np.minimum(end[k], ends[span]) - np.maximum(start[k], begins[span])
        if rule == "split":
            counts[span] += part / part.sum()
        else:
            counts[span[np.argmax(part)]] += 1
    return counts, crossing


def section_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    fields: list[str] | None = None,
    rule: str = "first",
    vocabulary: str | None = None,
) -> DataFrame:
    """Tokens of each section of each document: ``doc_id, section, start, end, n_tokens, n_crossing``.

    A document is encoded once as a whole. Its sections are its lines, or, where ``fields`` is given, those columns
    joined by a line feed each (which belongs to the field before it). A section's tokens are found by an interval
    join of token spans with section spans; ``rule`` (see RULES) says which section a token counts in that crosses a
    border, and ``n_tokens`` of a document's sections always add up to its tokens (a fraction under ``split``).

    Null counts as empty; an empty text has one empty section without tokens; repeated rows repeat their sections;
    an empty table gives no rows; other columns are ignored. No shuffle. Tokens of one document and the sections of
    a few thousand rows are held at a time.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = vocabulary or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (fields or [text_col])]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array(*cols).alias("parts"))

    def run(batches):
        for batch in batches:
            ids, parts = batch.column(0), batch.column(1)
            out: list[list] = [[], [], [], [], [], []]
            for k in range(len(parts)):
                own = parts[k].as_py()
                text = "\n".join(own)
                ends = line_sections(text) if fields is None else np.cumsum([len(p) + 1 for p in own])
                if fields is not None:
                    ends[-1] -= 1
                _, start, end = token_spans(text, path)
                counts, crossing = attribute(start, end, ends, rule)
                out[0].append(np.full(len(ends), k))
                out[1].append(np.arange(len(ends)))
                out[2].append(np.concatenate(([0], ends[:-1])))
                out[3].append(ends)
                out[4].append(counts)
                out[5].append(crossing)
                if sum(map(len, out[0][-100:])) > 100_000 or len(out[0]) >= 2000:
                    yield emit(ids, out)
                    out = [[], [], [], [], [], []]
            if out[0]:
                yield emit(ids, out)

    def emit(ids, out):
        at, section, start, end, counts, crossing = (np.concatenate(x) for x in out)
        counts = counts if rule == "split" else counts.astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array(section.astype(np.int32)), pa.array(start), pa.array(end), pa.array(counts), pa.array(crossing.astype(np.int64))],
            ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
        )

    number = "double" if rule == "split" else "long"
    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, end long, n_tokens {number}, n_crossing long")
