import random

import numpy as np
import pytest

from attestor.llm import decontaminate as D


def distance(item, text):
    """Fewest edits between the item and any piece of the text."""
    row = np.zeros(len(text) + 1, int)
    place = np.arange(len(text) + 1)
    for r, c in enumerate(item):
        new = np.concatenate(([r + 1], np.minimum(row[:-1] + (text != c), row[1:] + 1)))
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


@pytest.fixture(scope="module")
def items(words):
    rng = random.Random(9)
    return [(k, " ".join(rng.choices(words, k=rng.randint(12, 60))).capitalize() + ".") for k in range(15)] + [(90, None), (91, ""), (92, "short"), (93, "  ,. ")]


def edited(text, n, rng):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[k] = rng.choice("abcdefgh")
        elif kind == 1 and len(chars) > 1:
            del chars[k]
        else:
            chars.insert(k, rng.choice("abcdefgh"))
    return "".join(chars)


def test_same_as_full_alignment(words, items):
    rng = random.Random(11)
    index = D.build_index(items)
    for trial in range(60):
        k, text = items[rng.randrange(15)]
        budget = int(index.edits[index.ids.index(k)])
        body = edited(text, rng.randint(0, 2 * budget + 1), rng)
        doc = " ".join(rng.choices(words, k=40)) + " " + body + "! " + " ".join(rng.choices(words, k=40))
        codes, _ = D.normalise(doc)
        got = {index.ids[n]: e for n, e, _, _ in D.find_items(doc, index)}
        want = {}
        for n, i in enumerate(index.ids):
            d = distance(index.codes[n], codes)
            if d <= index.edits[n]:
                want[i] = d
        assert got == want, trial


def test_spans_of_verbatim_matches(items):
    index = D.build_index(items)
    doc = "Before,  " + items[3][1] + " after"
    ((n, edits, start, end),) = D.find_items(doc, index)
    assert (index.ids[n], edits) == (3, 0) and doc.lower()[start:end] == items[3][1].lower().rstrip(".")


def test_normalisation_and_hashes():
    codes, at = D.normalise("  Ab--\tÇ9 𝔘x! ")
    assert "".join(map(chr, codes)) == "ab ç9 𝔘x" and at[0] == 2
    text = np.frombuffer("abcdefghijklmnopabcdefghijklmnop".encode("utf-32-le"), np.uint32)
    for q in (1, 5, 12):
        h = D.gram_hashes(text, q)
        assert len(h) == len(text) - q + 1 and (h[:5] == h[16:21]).all() and len(set(h[:16].tolist())) == 16


@pytest.mark.parametrize("pass_chars", [10**9, 500])
def test_query_over_edges(spark, docs, corpus, items, pass_chars):
    rows = [(500, "intro " + items[0][1] + " x " + items[1][1].upper(), "s0")]
    more = docs.limit(0).unionByName(spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string"), allowMissingColumns=True)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.contamination(docs.unionByName(more), table, pass_chars=pass_chars).collect()}
    assert [m.item_id for m in got[500].matches] == [0, 1] and got[500].contaminated
    assert not got[300].contaminated and got[300].matches == []
    kept = D.decontaminate(docs.unionByName(more), table)
    assert kept.columns == docs.columns and kept.count() == len(corpus)


def test_empty_tables(spark, docs, empty, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert not any(r.contaminated for r in D.contamination(docs, none).collect())


@pytest.mark.parametrize("at_once", [50, 3000])
def test_frequent_grams_are_counted_over_the_whole_text(monkeypatch, words, at_once):
    monkeypatch.setattr(D, "AT_ONCE", at_once)
    rng = random.Random(21)
    shared = " ".join(rng.choices(words, k=40))
    items = [(k, f"{shared} {k:05d} {' '.join(rng.choices(words, k=3))}") for k in range(60)] + [(99, "ha " * 300)]
    index = D.build_index(items)
    for k in (7, 99):
        text = " ".join(rng.choices(words, k=30)) + " " + dict(items)[k] + " " + " ".join(rng.choices(words, k=30))
        assert [r[1] for r in D.find_items(text, index) if index.ids[r[0]] == k] == [0]


def test_items_of_one_text_are_searched_once_and_all_reported(spark):
    text = "a sentence that many benchmark items repeat word for word"
    items = spark.createDataFrame([(1, text), (2, text.upper()), (None, text), (3, "quite another benchmark item here")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {text} behind")], "doc_id long, text string")
    assert sorted((m.item_id for m in D.contamination(docs, items).first().matches), key=str) == [1, 2, None]


def test_short_items_match_as_whole_words(spark):
    items = spark.createDataFrame([(1, "Yes, no"), (2, "ok"), (3, "OK!"), (4, ""), (5, None), (6, "a much longer benchmark item")], "item_id long, text string")
    rows = [(1, "well: yes  NO?"), (2, "yes nope, oklahoma"), (3, "it is ok"), (4, "ok"), (5, None), (6, "A much longer benchmark item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for pass_chars in (10**6, 10):
        found = {r.doc_id: [m.item_id for m in r.matches] for r in D.contamination(docs, items, short_items=True, pass_chars=pass_chars).collect()}
        assert found == {1: [1], 2: [], 3: [2, 3], 4: [2, 3], 5: [], 6: [6]}
    assert {r.doc_id for r in D.contamination(docs, items).where("contaminated").collect()} == {6}


@pytest.mark.parametrize("pass_chars", [10**9, 60])
def test_clashing_columns_stay(spark, pass_chars):
    items = spark.createDataFrame([(1, "a sentence that stands in the benchmark"), (2, "one more sentence of the benchmark")], "item_id long, text string")
    rows = [(1, "quite clean", "yes", "m", "f", 4), (1, "ONE more sentence, of the benchmark", "no", "m", "f", 5), (None, None, "no", "n", "g", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated string, matches string, __found string, __row long")
    kept = D.decontaminate(docs, items, pass_chars=pass_chars)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
