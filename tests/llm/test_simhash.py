import random

import numpy as np
import xxhash

from attestor.llm import simhash as S


def slow_print(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    parent = {f: f for f in set(prints)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(parent)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in values}


def test_fingerprint(corpus):
    for _, text, _ in corpus:
        if text is None or len(text) < 5000:
            assert S.fingerprint(text) == slow_print(text)
    assert S.fingerprint("a b c " * 40_000) == slow_print("a b c " * 40_000)


def test_components_match_brute_force(docs, corpus):
    prints = [S.fingerprint(t) for _, t, _ in corpus]
    part = components(prints)
    least = {}
    for (i, _, _), f in zip(corpus, prints):
        if i is not None:
            least[part[f]] = min(least.get(part[f], i), i)
    want = sorted(((i, f"{f:016x}", least.get(part[f])) for (i, _, _), f in zip(corpus, prints)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_links_lose_nothing_in_hot_keys(spark):
    """Fingerprints around one centre, many more than a block holds."""
    from attestor.llm.common import Workspace

    rng = random.Random(1)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(100)}
    df = spark.createDataFrame([(S._signed(f),) for f in prints], "fp long")
    work = Workspace(spark, "t")
    for block, segments in ((20, None), (4096, 5), (4096, 7)):
        found = S.links(df, work, block=block, segments=segments).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in found)
        part = components(prints)
        parent = {S._signed(f): S._signed(f) for f in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in found:
            parent[find(r.a)] = find(r.b)
        groups = lambda of: sorted(sorted(g) for g in _group(of))
        assert groups({S._signed(f): S._signed(p) for f, p in part.items()}) == groups({f: find(f) for f in parent})


def _group(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, []).append(k)
    return out.values()


def test_pivot_filter_keeps_all_near_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 50, np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64((1 << a) | (1 << b)) for a, b in ((0, 1), (5, 40), (63, 2))] + [base]))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    got = {(int(i), int(j)) for a, b, _ in S.near_pairs(fps, fps, S.pivots()) for i, j in zip(a, b)}
    assert got == want


def test_keep_one(docs, corpus):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(309) == 1 and 100 in ids and not set(range(101, 106)) & set(ids)
    assert ids.count(None) == 1  # the other null id has a null text, as empty as 301


def test_keep_one_by_row(spark):
    """Ids that repeat or are null name no row; columns keep their names and values."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (None, c, "s"), (None, c.upper(), "t"), (None, b, "u"), (7, "z", "v"), (7, "z", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __hash string").withColumnsRenamed({"text": "body"})
    for keep in (S.keep_one, S.keep_similar_one):
        got = keep(df, text_col="body")
        assert got.columns == df.columns
        rest = sorted((r.doc_id, r.body[:2], r["__hash"]) for r in got.collect() if r.doc_id)
        assert rest == [(1, "a0", "p"), (5, "b0", "r"), (7, "z", "v")] and got.count() == 4


def test_pivot_keys():
    """Fingerprints within three bits share a key whatever the bits; keys tell other fingerprints apart."""
    rng = random.Random(4)
    one = [rng.getrandbits(64) for _ in range(200)]
    two = [f ^ sum(1 << b for b in rng.sample(range(64), 3)) for f in one]
    for segments in (5, 6, 7):
        left, right = ([set(r) for r in S.pivot_keys(np.array(fps, np.uint64), segments).tolist()] for fps in (one, two))
        assert all(a & b for a, b in zip(left, right))
        assert sum(len(left[i] & left[j]) for i in range(200) for j in range(i)) <= 5
    assert [S.segments_for(n) for n in (0, 10**6, 10**9, 10**10)] == [5, 5, 6, 7]


def test_small_groups_find_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 30, np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 63), base ^ np.uint64(0xFF)])
    group, own = np.sort(rng.integers(0, 12, len(fps))), np.arange(len(fps)) % 2
    for mixed in (np.zeros(len(fps), bool), np.ones(len(fps), bool)):
        near = lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 3 and group[i] == group[j] and (not mixed[i] or own[i] != own[j])
        want = {(i, j) for j in range(len(fps)) for i in range(j) if near(i, j)}
        got = [(int(x), int(y)) for i, j in S.near_neighbours(fps, group, own, mixed, S.pivots()) for x, y in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(empty):
    assert S.near_duplicates(empty).collect() == [] and S.keep_one(empty).collect() == []
