import hashlib
from collections import defaultdict

import pytest

from attestor.llm import exact_dedup as X


def brute(corpus):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[(t or "").translate(low)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16, 100, 4096])
def test_matches_brute_force(docs, corpus, block):
    got = X.exact_duplicates(docs, block=block).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(corpus)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_prints_that_blocks_share_are_told_apart(docs, corpus):
    got = X.exact_duplicates(docs, block=64, prints=lambda b: len(b) % 5).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(corpus)


def test_empty_table(empty):
    assert X.exact_duplicates(empty).collect() == []
