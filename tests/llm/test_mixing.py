import re
from collections import defaultdict

import pytest

from attestor.llm import mixing as M


def levels(sizes, cap=3):
    """Targets by repeated clamping, sources in order."""
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sizes)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weight.items() if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = [s for s in share if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_takes(docs, corpus):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in sorted(corpus, key=lambda r: (r[2] is None, r[2] or "")):
        sizes[s] += count(t)
    want = levels(dict(sizes))
    rows = M.mix(docs).collect()
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((i, count(t)) for i, t, _ in corpus if i is not None)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.repeats * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(docs):
    once = sorted((tuple(r) for r in M.mix(docs).collect()), key=str)
    assert sorted((tuple(r) for r in M.mix(docs.repartition(7)).collect()), key=str) == once


def test_apply_repeats_rows(docs):
    out = M.apply_mix(docs)
    assert out.columns == docs.columns
    want = defaultdict(int)
    for r in M.mix(docs).collect():
        want[r.doc_id] = max(want[r.doc_id], r.repeats)
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    rows = defaultdict(int)
    for r in docs.collect():
        rows[r.doc_id] += 1
    assert dict(got) == {i: n * rows[i] for i, n in want.items() if n}


def test_empty_tables(spark, empty, docs):
    assert M.mix(empty).collect() == [] and M.apply_mix(empty).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in M.mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_text_ids_and_clashing_columns(spark):
    rows = [(f"d{k}", "w " * (k + 1), "ab"[k % 2], k, k) for k in range(12)] + [(None, "w w", "a", 1, 1), (None, None, None, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, __repeats long, __turn long")
    found = M.mix(docs).collect()
    assert len(found) == len(rows)
    took = {}
    for r in found:
        took[r.doc_id] = max(took.get(r.doc_id, 0), r.repeats)
    out = M.apply_mix(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in rows for _ in range(took[r[0]])), key=str)
