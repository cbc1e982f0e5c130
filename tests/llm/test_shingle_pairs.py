import random

import pytest

import corpus_pipeline as P
from attestor.llm import shingle_pairs as S
from attestor.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(words):
    """Texts of which some share most shingles, with one large group of edited copies."""
    rng = random.Random(11)
    base = [rng.choices(words, k=n) for n in [30, 60, 200, 400, 1200]]
    rows = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 4, 8):
            own = b.copy()
            for k in rng.sample(range(len(own)), edits):
                own[k] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(own))
        rows += [" ".join(b[: int(len(b) * f)]) for f in (0.95, 0.81, 0.78)]
    for _ in range(60):
        own = base[2].copy()
        for k in rng.sample(range(200), rng.choice([1, 2, 5])):
            own[k] = f"new{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    rows += [base_text.upper() for base_text in rows[:3]] + [None, "", " \t", "one two", "ONE  two", "one three"]
    return [(i, t) for i, t in enumerate(rows)]


def brute(rows):
    sets = {i: set(S.shingles(t).tolist()) for i, t in rows}
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                least[b] = a
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("lags, sample", [(32, 5000), (2, 0)])
def test_equals_brute_force(spark, words, lags, sample):
    rows = near_copies(words)
    docs = spark.createDataFrame(rows + rows[:2] + [(None, rows[0][1])], "doc_id long, text string").repartition(3)
    got = simhash.similar_documents(docs, lags=lags, sample=sample).collect()
    want = brute(rows) | {None: 0}
    assert len(got) == len(rows) + 3 and {r.doc_id: r.component_id for r in got} == want
    kept = [r.doc_id for r in simhash.keep_similar_one(docs, lags=lags, sample=sample).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_pipeline_stage_drops_edited_copies(spark, words):
    rng = random.Random(12)
    rows = []
    for i in range(20):
        own = rng.choices(words, k=120)
        rows.append((i, " ".join(own), "en", "s0", 0))
        for k in rng.sample(range(120), 2):  # at most 10 of 116 shingles differ
            own[k] = "edited"
        rows.append((100 + i, " ".join(own), "en", "s1", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == list(range(20))


def test_empty_table(spark):
    assert simhash.keep_similar_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dense_groups_are_joined_by_few_rows(spark, words, monkeypatch):
    rng, rows = random.Random(13), []
    base = rng.choices(words, k=200)
    for i in range(300):
        own = base.copy()
        for k in rng.sample(range(200), rng.choice([1, 2, 3])):
            own[k] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    sizes, save = {}, simhash.Workspace.save

    def counted(self, df, table):
        out = save(self, df, table)
        sizes[table] = out.count()
        return out

    monkeypatch.setattr(simhash.Workspace, "save", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.component_id for r in simhash.similar_documents(docs).collect()} == {0}
    assert sizes["cc_0"] < 300 and sizes["near_possible"] < 20 * 300
    assert sizes["far"] > 0 and sizes.get("far_possible", 0) == 0
