import numpy as np
import pytest

from attestor.llm import token_counts as T


def brute(text, rule):
    """Counts by walking over every token and character."""
    encoding, _ = T._encoding(T.vocabulary_path())
    data, owner, chars = text.encode(), [], []
    section = 0
    for k, c in enumerate(text):
        chars += [k] * len(c.encode())
        owner.append(section)
        section += c == "\n"
    n = (owner[-1] if owner else 0) + 1
    counts, crossing, at = [0.0] * n, [0] * n, 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        span = range(chars[at], chars[at + size - 1] + 1)
        at += size
        own = [owner[c] for c in span]
        crossing[own[0]] += own[0] != own[-1]
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "last":
            counts[own[-1]] += 1
        elif rule == "most":
            counts[max(sorted(set(own)), key=own.count)] += 1
        else:
            for s in set(own):
                counts[s] += own.count(s) / len(own)
    assert at == len(data)
    return counts, crossing


TEXTS = ["", "one line", "a\n\nb\n\n\n  c", "é\nñandú 日本語\n😀 x", "\n", "\n\n\n\n", "word \n word\n\tx\n \n \ny"]


@pytest.mark.parametrize("rule", T.RULES)
def test_attribution(rule, corpus):
    for text in TEXTS + [t for _, t, _ in corpus if t and len(t) < 500]:
        _, start, end = T.token_spans(text, T.vocabulary_path())
        counts, crossing = T.attribute(start, end, T.line_sections(text), rule)
        want, want_crossing = brute(text, rule)
        assert counts.tolist() == pytest.approx(want) and crossing.tolist() == want_crossing


def test_rows(spark, docs, corpus):
    rows = T.section_counts(docs).collect()
    encoding, _ = T._encoding(T.vocabulary_path())
    total = lambda i: sum(r.n_tokens for r in rows if r.doc_id == i)
    for i, t, _ in corpus:
        if i is not None and i != 309:
            assert total(i) == len(encoding.encode_ordinary(t or ""))
    assert [(r.section, r.start, r.end, r.n_tokens) for r in rows if r.doc_id == 300] == [(0, 0, 0, 0)]
    assert sum(r.doc_id == 309 for r in rows) == 2


def test_fields(spark):
    df = spark.createDataFrame([(1, "Title", "Body text\nmore"), (2, None, ""), (3, "", None)], "doc_id long, title string, text string")
    rows = T.section_counts(df, fields=["title", "text"]).collect()
    encoding, _ = T._encoding(T.vocabulary_path())
    assert [(r.doc_id, r.section, r.start, r.end) for r in rows if r.doc_id == 1] == [(1, 0, 0, 6), (1, 1, 6, 20)]
    for i, text in ((1, "Title\nBody text\nmore"), (2, "\n"), (3, "\n")):
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == len(encoding.encode_ordinary(text))


def test_empty_table_and_bad_rule(empty):
    assert T.section_counts(empty).collect() == []
    with pytest.raises(ValueError):
        T.section_counts(empty, rule="other")
