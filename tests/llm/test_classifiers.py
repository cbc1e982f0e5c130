import random
import zlib

import numpy as np
import pytest

from attestor.llm import quality, toxicity
from attestor.llm.training import labelled_sample

BAD = ["scumbag", "worthless", "idiotic"]


def texts(words, n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = rng.choices(words, k=rng.randint(5, 200))
        if k % 2:
            for _ in range(max(1, len(own) // 50)):
                own[rng.randrange(len(own))] = rng.choice(BAD)
        out.append((" ".join(own), k % 2))
    return out


def test_toxicity_learns_and_knows_misspellings(words):
    model = toxicity.train(texts(words, 300, 1))
    scorer = toxicity.Scorer(model)
    test = texts(words, 200, 2)
    right = [(scorer.logit(t) >= 0) == bool(y) for t, y in test]
    assert np.mean(right) > 0.97
    assert scorer.logit("what a scumbagg this is") > 0 > scorer.logit("")
    assert scorer.logit(None) == scorer.logit(" \n")


def test_toxicity_word_table_forgets_without_change(words):
    model = toxicity.train(texts(words, 100, 3))
    small = toxicity.Scorer(model)
    small.table.limit = 10
    large = toxicity.Scorer(model)
    for t, _ in texts(words, 20, 4):
        assert small.logit(t) == large.logit(t)


def junk(words, n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = rng.choices(words, k=rng.randint(20, 300))
        if k % 2 == 0:
            own = rng.choice([[w.upper() + "!!" for w in own], [own[0]] * len(own), [x for w in own for x in (w, "|")]])
        out.append((" ".join(own), k % 2))
    return out


def test_quality_learns(words):
    model = quality.train(junk(words, 200, 1))
    features = quality.Features()
    test = junk(words, 200, 2)
    assert np.mean([(model.logit(*features.of(t)) >= 0) == bool(y) for t, y in test]) > 0.97


def test_factorisation_identity():
    """The logit equals the sum over all pairs of features."""
    rng = np.random.default_rng(1)
    size, k = len(quality.STATISTICS), quality.FACTORS
    model = quality.Model(
        0.3, rng.normal(size=quality.BUCKETS), rng.normal(size=(quality.BUCKETS, k)), rng.normal(size=size), rng.normal(size=(size, k)),
        rng.normal(size=size), rng.uniform(0.5, 2, size),
    )
    places, stats = np.array([3, 77, 5000]), rng.normal(size=size)
    s = np.clip((stats - model.mean) / model.scale, -4, 4)
    x = np.concatenate([np.full(3, 1 / np.sqrt(3)), s])
    w = np.concatenate([model.weight[places], model.stat_weight])
    v = np.concatenate([model.factor[places], model.stat_factor])
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert model.logit(places, stats) == pytest.approx(0.3 + w @ x + pairs)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_all_rows(spark, docs, corpus, empty, words, module):
    made = texts(words, 120, 5)
    known = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    marks = [(i, y, y) for i, (_, y) in enumerate(made)] + [(None, 1, 1), (3, None, None), (9999, 1, 1), (4, 7, 7)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    model = module.fit(known, labels, per_class=50)
    rows = module.score(docs, model).collect()
    assert len(rows) == len(corpus) and set(docs.columns) <= set(rows[0].asDict())
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % module.FOLDS == module.HELD)
    same = [r.score for r in rows if r.doc_id == 309]
    assert same[0] == same[1]
    assert module.score(empty, model).collect() == []
    blank = module.fit(known, labels.limit(0))
    assert {0 <= r.score <= 1 for r in module.score(docs, blank).collect()} == {True}


def test_sample_leaves_out_held_rows(spark):
    known = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = labelled_sample(known, labels, label="toxic", folds=5, fold=0, per_class=1000)
    ids = {int(t.split()[1]) for t, _ in rows}
    assert ids == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    assert len(labelled_sample(known, labels, label="toxic", folds=5, fold=0, per_class=7)) == 14


def plain_toxicity(text, model):
    """The score of a text by loops over its bags, words and character n-grams."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ h >> 29) * 0x9E3779B97F4A7C15) & mask
        return (h >> 47) % toxicity.BUCKETS

    def grams(word):
        marked = f"<{toxicity.clean(word)}>"
        if len(marked) <= 2:
            return []
        base, codes = 0x100000001B3, [ord(c) for c in marked]
        out = [mixed((sum(c * pow(base, i + 1, 1 << 64) for i, c in enumerate(codes)) + 99) & mask)]
        for n in toxicity.GRAMS:
            for k in range(len(codes) - n + 1 if len(codes) > n else 0):
                h = n
                for c in codes[k : k + n]:
                    h = (h * base + c) & mask
                out.append(mixed(h))
        return out

    words = (text or "").lower().split()
    pieces = max(1, -(-len(words) // toxicity.WINDOW))
    ends = [k * len(words) // pieces for k in range(pieces + 1)]
    best = []
    for a, b in zip(ends, ends[1:]):
        own = [g for w in set(words[a:b]) for g in grams(w)]
        best.append(sum(float(model.weight[g]) for g in own) / (len(own) + toxicity.PRIOR))
    return 1 / (1 + np.exp(-(max(best) + model.bias)))


def test_toxicity_scores_equal_brute_force(spark, words):
    rng = random.Random(6)
    model = toxicity.Model(np.random.default_rng(6).normal(size=toxicity.BUCKETS).astype(np.float32), 0.25)
    rows = [(k, t) for k, (t, _) in enumerate(texts(words, 30, 9))] + [(50, None), (51, ""), (52, "... !!"), (53, "Straße, ÉTÉ 日本 a"), (54, " ".join(rng.choices(words, k=5000)))]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == pytest.approx({i: plain_toxicity(t, model) for i, t in rows}, rel=1e-6)


def plain_quality(text, model):
    """The score of a text by loops over words, windows and pairs of features."""
    text = text or ""
    words, stats = text.split(), [0.0] * len(quality.STATISTICS)
    if words:
        n, lines = len(words), [x for x in text.split("\n") if x.strip()]
        chars = sum(map(len, words))
        size = [len(w) for w in words]
        punct = [sum(not c.isalnum() for c in w) for w in words]
        upper = [sum(c.isupper() for c in w) for w in words]
        digit = [sum(c.isdigit() for c in w) for w in words]
        again = [0] + [int(a == b) for a, b in zip(words, words[1:])]
        pieces = max(1, n // quality.WINDOW)
        ends = [k * n // pieces for k in range(pieces + 1)]
        spans = list(zip(ends, ends[1:]))
        share = lambda of, a, b: sum(of[a:b]) / sum(size[a:b])
        variety = [len(set(words[a:b])) / (b - a) for a, b in spans]
        stats = [
            np.log1p(n), np.log1p(len(text)), np.log1p(len(lines)), np.log1p(n / max(1, len(lines))), chars / n, np.std(size), sum(punct) / chars, sum(upper) / chars,
            sum(digit) / chars, np.mean([p == s for p, s in zip(punct, size)]), np.mean(variety), min(variety), max(share(punct, a, b) for a, b in spans),
            max(share(upper, a, b) for a, b in spans), max(share(digit, a, b) for a, b in spans), sum(again) / n, max(sum(again[a:b]) / (b - a) for a, b in spans),
            max(sum(size[a:b]) / (b - a) for a, b in spans), 1 - len(set(lines)) / max(1, len(lines)), np.mean([s < 3 for s in size]),
        ]
    places = sorted({zlib.crc32(quality.clean(w).lower().encode()) % quality.BUCKETS for w in words})
    s = np.clip((np.array(stats) - model.mean) / model.scale, -4, 4)
    x = np.concatenate([np.full(len(places), 1 / np.sqrt(max(1, len(places)))), s])
    w = np.concatenate([model.weight[places], model.stat_weight])
    v = np.concatenate([model.factor[places], model.stat_factor])
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    return 1 / (1 + np.exp(-(model.bias + w @ x + pairs)))


def test_quality_scores_equal_brute_force(spark, words):
    rng, size, k = np.random.default_rng(2), len(quality.STATISTICS), quality.FACTORS
    model = quality.Model(
        0.1, rng.normal(0, 0.3, quality.BUCKETS), rng.normal(0, 0.1, (quality.BUCKETS, k)), rng.normal(0, 0.2, size), rng.normal(0, 0.1, (size, k)),
        rng.normal(size=size), rng.uniform(1, 2, size),
    )
    rows = [(i, t) for i, (t, _) in enumerate(junk(words, 20, 4))] + [(50, None), (51, " \n"), (52, "One LINE\n\nOne LINE\nthe the the 12 a!"), (53, "| | é")]
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == pytest.approx({i: plain_quality(t, model) for i, t in rows}, rel=1e-6)


def test_texts_that_share_an_id_are_chosen_alike(spark):
    rows = [(i % 20, f"text {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    picked = [labelled_sample(spark.createDataFrame(rows[::step], "doc_id long, text string").repartition(n), labels, label="toxic", folds=5, fold=0, per_class=100) for step, n in ((1, 1), (-1, 7))]
    assert picked[0] == picked[1] and len(picked[0]) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(20))


def test_keep_clean_leaves_columns_alone(spark):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    rows = [(1, "a", "high", 0.9, "x"), (None, None, "low", 0.1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double, held_out string")
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows, key=str)
    assert toxicity.keep_clean(docs, toxicity.Model(model.weight, 1.0)).count() == 0
