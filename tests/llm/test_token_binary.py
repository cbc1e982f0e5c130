import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestor.llm import mixing_coder as C
from attestor.llm import token_binary as T


@pytest.mark.parametrize("n", [1, 2, 7, 255, 512, 9000, 70_000])
@pytest.mark.parametrize("kind", ["uniform", "skewed", "same", "cycle"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "uniform": rng.integers(0, 49408, n), "skewed": rng.zipf(1.4, n) % 49408, "same": np.full(n, 49407), "cycle": np.arange(n) % 5 * 9000,
    }[kind].astype(np.int64)
    used, words = C.encode_block(ids, 49408)
    assert used.sum() == len(words) and (C.decode_block(used, words, n, 49408) == ids).all()
    if n > 8000 and kind in ("same", "cycle"):
        assert 4 * len(words) < n / 2
    if n > 60_000 and kind == "skewed":
        share = np.unique(ids, return_counts=True)[1] / n
        assert 32 * len(words) < 1.2 * n * -(share * np.log2(share)).sum()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.sampled_from([301, 5_000_000]))
def test_coder_round_trip_of_any_ids(ids, alphabet):
    ids = np.array(ids) * (alphabet // 301)
    used, words = C.encode_block(ids, alphabet)
    assert (C.decode_block(used, words, len(ids), alphabet) == ids).all()


def test_carries():
    """Ranges that end at a word's border send carries back into words already written."""
    rng = np.random.default_rng(1)
    for n in (300, 3000):
        for _ in range(30):
            ids = np.where(rng.random(n) < 0.97, 9, rng.integers(0, 12, n))
            used, words = C.encode_block(ids, 12)
            assert (C.decode_block(used, words, n, 12) == ids).all()


def named(ids, counts):
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_segments_round_trip_and_notice_damage(block):
    ids = np.arange(5000) % 700
    data = T.write_segment(ids, named([5, None, 7], [3000, 0, 2000]), 1000, block)
    back, table = T.read_segment(data)
    assert (back == ids).all() and table.to_pydict() == {"doc_id": [5, None, 7], "n_tokens": [3000, 0, 2000]}
    for at in (60, len(data) // 2, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 0x40
        with pytest.raises(ValueError):
            T.read_segment(bytes(broken))
    for cut in (data[:10], data[:-5], b""):
        with pytest.raises(ValueError):
            T.read_segment(cut)
    back, table = T.read_segment(T.write_segment(np.empty(0, np.int32), named(["a"], [0]), 1000))
    assert not len(back) and table.column(0).to_pylist() == ["a"]


TEXTS = [
    None, "", " \n", "Hello, World!", "don't we'll I'M o'clock", "naïve café Straße ΣΑΣ ς İstanbul", "áb ́c", "tab\tand\x0bvt nbsp em",
    "x" * 3000, "1234 5,6 7.8%", "<|endoftext|> a<|startoftext|>b", "...!!! ???,,,", "日本語 テキスト", "😀 ok 👍🏽", "ﬁ ﬂ ½ ²", "A.B.C. e.g., i.e.;",
]


def direct(texts, path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or T.vocabulary_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("limit", [5, 100_000])
def test_encoder_equals_whole_text_encoding(corpus, limit):
    texts = TEXTS + [t for _, t, _ in corpus]
    encoder = T.Encoder(T.vocabulary_path(), limit=limit)
    for _ in range(2):
        ids, counts = encoder.batch(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == direct(texts)


@pytest.mark.parametrize("segment", [500, 10**7])
def test_output_of_all_rows(spark, docs, corpus, segment):
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for (i, _, _), ids in zip(rows, direct([t for _, t, _ in rows])):
        raw = np.array(ids + [2], "<u4")
        want.append((i, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    got = T.token_output(docs, segment=segment).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_ids_are_in_the_files(spark, docs):
    from attestor.llm.common import Workspace

    path = Workspace(spark, "t").path("files")
    T.write_tokens(docs.where("doc_id < 5"), path)
    rows = {r.doc_id: r.ids for r in T.read_tokens(spark, path, with_ids=True).collect()}
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 5").collect()}
    assert rows == {i: direct([t])[0] + [2] for i, t in texts.items()}


def test_empty_table(empty):
    assert T.token_output(empty).collect() == []


def test_letters_that_normalise_to_marks_before_punctuation():
    texts = ["DİYARLİ. x", "DİYARLİ", "İ!? İ. a", "\u0958. b", "\ufb2a. c", "a\u0958, İ;"]
    ids, counts = T.Encoder(T.vocabulary_path()).batch(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == direct(texts)


def test_other_vocabularies_encode_whole_texts(corpus, tmp_path):
    """A cased copy of the vocabulary and one of other steps."""
    import json

    spec = json.loads(open(T.vocabulary_path()).read())
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(spec))
    texts = TEXTS + [t for _, t, _ in corpus[:20]]
    for path in (str(cased), T.vocabulary_path("byte_bpe_50k.json")):
        ids, counts = T.Encoder(path).batch(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == direct(texts, path)
    assert T.Encoder(str(cased)).by_piece


def test_text_ids(spark):
    rows = [("b", "two words"), ("a", "one"), (None, "none"), ("a", "again"), ("é", None)]
    got = T.token_output(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, "a", "a", "b", "é"]
    assert sorted(r.n_tokens for r in got) == [1, 2, 2, 2, 3]


def test_letters_that_are_encoded_as_words():
    """Each is in normal form C, alone and behind others, and Arrow lower-cases it to the one letter that it should."""
    letters = pa.array([chr(c) for c in range(1, 0xD800)])
    kept = pc.match_substring_regex(letters, T._LATIN)
    low = pc.utf8_lower(letters.filter(kept)).to_pylist()
    held = letters.filter(kept).to_pylist()
    assert len(held) == 449 and "İ" not in held and low == [c.lower() for c in held] and max(map(len, low)) == 1
    assert unicodedata.is_normalized("NFC", "".join(held)) and not any(map(unicodedata.combining, held))


def test_words_met_before_are_not_encoded_again():
    """Of many different words, as many as a worker meets in some hundred MB of text."""
    encoder, asked = T.Encoder(T.vocabulary_path()), []
    words = encoder._words
    encoder._words = lambda fresh: asked.append(len(fresh)) or words(fresh)
    text = [" ".join(f"é{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(at, at + 100_000)) for at in (0, 100_000, 200_000)]
    for t in text + text:
        encoder.batch(pa.array([t, t + "!"]))
    assert asked == [100_000] * 3


def word(k):
    return "q" + "".join(chr(97 + k // 26**i % 26) for i in range(5))


def test_pieces_are_forgotten_but_for_those_met_again():
    encoder, asked = T.Encoder(T.vocabulary_path(), limit=3000), []
    words = encoder._words
    encoder._words = lambda fresh: asked.extend(fresh) or words(fresh)
    often = [f"often{chr(97 + k)}" for k in range(20)]
    for at in range(0, 20_000, 1000):
        texts = [" ".join(often), " ".join(map(word, range(at, at + 1000))) + "!"]
        ids, counts = encoder.batch(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == direct(texts)
        assert len(encoder.number) <= 3000 + 1000 + 30
    assert len(asked) == 20_000 + 20


def test_a_worker_keeps_some_hundred_thousand_pieces():
    """However many it meets: two workers and the JVM share an executor's memory."""
    encoder, most = T.Encoder(T.vocabulary_path()), 0
    encoder._words = lambda fresh: [[1]] * len(fresh)
    for at in range(0, 800_000, 50_000):
        encoder.batch(pa.array([" ".join(map(word, range(at, at + 50_000)))]))
        most = max(most, len(encoder.number))
    assert most < 400_000 and len(encoder.store) < 1_600_000
