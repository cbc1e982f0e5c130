import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, key string, score double, row long, h long, name string, matches string"


def with_extras(rows):
    """Documents (doc_id, text, source) with columns whose names clash with the operators' own."""
    return [(i, t, "en", s, 0, 1, 2, "k", 0.5, 3, 4, "n", "m") for i, t, s in rows]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text, source): ordinary texts, copies, near copies, nulls, empty, blank and long texts, repeated rows, null ids."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.randint(1, 120)), f"s{i % 4}") for i in range(40)]
    base = text(300)
    rows += [(100 + i, base, "s0") for i in range(6)]
    near = base.split()
    for i in range(6):
        own = near.copy()
        own[rng.randrange(300)] = "changed"
        rows.append((200 + i, " ".join(own), "s1"))
    rows += [(300, None, "s2"), (301, "", "s2"), (302, " \t\n", None), (303, base.upper(), None), (304, "ÉÀ Straße ß", None)]
    rows += [(305, text(30_000), "s3"), (306, "x" * 50_000, "s3"), (307, "one two", "s9"), (308, "one two three", "s9")]
    rows += [(309, "same row", "s1"), (309, "same row", "s1"), (None, "no id", "s1"), (None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(with_extras(corpus), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
