"""Joins and searches that are cut into parts give what a plain comparison of all rows gives."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.config import EngineConfig, domain_list, label_set, text_list
from attestor.functions import text as tx
from attestor.functions import urls
from attestor.operators import chunks, index, pages, retrieve, stance, vectors
from attestor.plans import timing
from attestor.plans.numbering import number_rows
from attestor.streaming import state


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["the"] * 60 + ["and"] * 40
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(60)] + [(90, None), (91, ""), (92, "the and the and the")]
    return rows


def test_lexical_pairs(spark, texts):
    left = spark.createDataFrame(texts[:20] + texts[-3:], "claim_id long, text string")
    right = spark.createDataFrame(texts, "evidence_id long, text string")
    for least in (0.12, 0.25, 0.6):
        got = {(r.claim_id, r.evidence_id): r.lexical for r in retrieve.lexical_pairs(left, right, least).collect()}
        want = {}
        for i, a in texts[:20] + texts[-3:]:
            own = re.findall(r"\w{3,}", a or "")
            for j, b in texts:
                held = re.findall(r"\w{3,}", b or "")
                if own:
                    x = np.floor(min(1.0, sum(min(own.count(w), held.count(w)) for w in set(own)) / len(set(own))) * 1e4 + 0.5) / 1e4
                    if x >= least:
                        want[i, j] = x
        assert got == want


def test_lexical_pairs_leave_texts_and_pairs_where_they_are(spark, texts, monkeypatch):
    left = spark.createDataFrame(texts[:20], "claim_id long, text string")
    right = spark.createDataFrame([(str(k), t, k % 3) for k, t in texts], "evidence_id string, text string, g int")
    whole = retrieve.lexical_pairs(left, right, 0.12, keep=("g",))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, whole.collect()))
    assert want and all(int(r[1]) % 3 == r[2] for r in want)
    monkeypatch.setattr(retrieve, "PASS_WORDS", 100)
    monkeypatch.setattr(retrieve, "STEP", 50)
    assert sorted(map(tuple, retrieve.lexical_pairs(left, right, 0.12, keep=("g",)).collect())) == want


def test_lexical_pairs_rows_of_one_id_are_one_text(spark):
    left = spark.createDataFrame([(1, "alpha beta gamma delta"), (None, "alpha")], "claim_id long, text string")
    right = spark.createDataFrame([(7, "alpha beta", "a"), (7, "gamma", "b"), (8, "delta", "c"), (None, "alpha", "d")], "evidence_id long, text string, source string")
    assert sorted(map(tuple, retrieve.lexical_pairs(left, right, 0.1).collect())) == [(1, 7, 0.75), (1, 8, 0.25)]
    assert sorted(map(tuple, retrieve.lexical_pairs(left, right, 0.1, keep=("source",)).collect())) == [(1, 7, "a", 0.75), (1, 7, "b", 0.75), (1, 8, "c", 0.25)]
    assert retrieve.lexical_pairs(left.where("claim_id is null"), right, 0.1).count() == 0


def test_candidates_carry_no_texts(spark):
    """What ranking sorts and deals out are ids and numbers; texts come to the few that are left."""
    from attestor.plans import queries

    rows = queries._candidates(spark, "/root/testdata/sf0.001")
    assert not {"text", "evidence_text"} & set(rows.columns) and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert not {"text", "evidence_text"} & set(queries._prepared_pairs(spark, "/root/testdata/sf0.001").columns)


def test_texts_are_judged_once_and_stay_where_they_are(spark, monkeypatch):
    from attestor.plans import queries

    kept, write = {}, queries.written

    def noted(df, name):
        out = write(df, name)
        kept[name] = (df._jdf.queryExecution().optimizedPlan().toString(), out)
        return out

    monkeypatch.setattr(queries, "written", noted)
    rows = queries._judgeable(spark, "/root/testdata/sf0.001").collect()
    plan, judged = kept["judgeable"]
    assert len(rows) == kept["ranked"][1].count() > judged.count() == len({r.evidence_id for r in rows})
    assert "broadcast" in plan and not {"text", "evidence_words", "evidence_text"} & set(judged.columns)


def test_rank_evidence_without_texts(spark):
    kinds = "claim_id long, evidence_id long, layer string, pos int, url string, text string, similarity double, trusted boolean"
    rows = [(k % 2, k, ["gdelt", "wikipedia", None][k % 3], 0, [None, "", "https://a.com/1", f"https://a.com/{k}"][k % 4], ["x " * (10 + k % 30), "Same start " * 9, None][k % 3], 0.1 + k / 100, k % 5 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, kinds)
    bare = df.withColumn("chars", F.length(F.trim("text"))).withColumn("start", retrieve.text_start(F.col("text"))).drop("text")
    got, want = (sorted((r.claim_id, r["rank"], r.evidence_id, r.rank_score) for r in retrieve.rank_evidence(x).collect()) for x in (bare, df))
    assert got == want and got


def test_token_pairs(spark, texts):
    tokens = [(k, sorted(set((t or "").split()))) for k, t in texts]
    left = spark.createDataFrame(tokens, "claim_id long, claim_tokens array<string>").withColumn("g", F.col("claim_id") % 2)
    right = spark.createDataFrame(tokens, "evidence_id long, evidence_tokens array<string>").withColumn("g", F.col("evidence_id") % 2)
    for least in (1, 2, 5):
        for by in ((), ("g",)):
            got = {(r.claim_id, r.evidence_id): r.overlap for r in retrieve.token_pairs(left, right, least=least, by=by).collect()}
            want = {(i, j): len(set(a) & set(b)) for i, a in tokens for j, b in tokens if len(set(a) & set(b)) >= least and (not by or i % 2 == j % 2)}
            assert got == want


def test_same_article_pairs(spark):
    rng = random.Random(3)
    parts = ["banco", "central", "juros", "copom", "taxa", "decide", "hoje", "brasil", "ata"]
    rows = [(k, f"https://{'www.' if k % 3 else ''}site{k % 2}.com/{rng.choice(['a', 'b'])}/" + "-".join(rng.sample(parts, rng.randint(1, 7))) + rng.choice(["", "/", ".html", "/amp/"])) for k in range(60)]
    rows += [(70, "https://site1.com/"), (71, "https://site1.com"), (72, None), (73, ""), (74, "no address"), (75, "no address/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {(r.page_id, r.other_id) for r in retrieve.same_article_pairs(df, "page_id").collect()}
    both = df.alias("a").crossJoin(df.alias("b")).where("a.page_id < b.page_id")
    want = both.where(urls.same_article(F.col("a.url"), F.col("b.url"))).select(F.col("a.page_id").alias("x"), F.col("b.page_id").alias("y"))
    assert got == {(r.x, r.y) for r in want.collect()} and len(got) > 20


def test_cosine_matrix_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(23, 4)).round(3)
    df = spark.createDataFrame([(k, v[k].tolist()) for k in range(23)], "label int, v array<double>")
    want = {(i, j): float(v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j])) for i in range(23) for j in range(i + 1, 23)}
    for block in (5, 2048):
        rows = vectors.cosine_matrix(df, "label", "v", block).collect()
        assert len(rows) == len(want) and {(r.label, r.other): r.cosine for r in rows} == pytest.approx(want, abs=1e-6)


def test_top_hits_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.integers(-2, 3, (80, 3)).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    df = spark.createDataFrame([(k, k % 9, v[k].tolist()) for k in range(80)], "vec_id long, base_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    want = set()
    for i in range(10):
        s = np.floor(v @ v[i] * 1e6 + 0.5) / 1e6
        for n, k in enumerate(sorted((k for k in range(80) if s[k] >= 0.3), key=lambda k: (-s[k], k))[:5]):
            want.add((i, k, k % 9, n + 1))
    for limit in (2_000_000, 9):
        monkeypatch.setattr(vectors, "PASS_VALUES", limit)
        assert {(r.query_id, r.vec_id, r.base_id, r.n) for r in vectors.top_hits(df, asked, 5, 0.3).collect()} == want


def test_memo_and_first_text_of_a_prefix(spark):
    rows = [(1, "abcX"), (2, "abcA"), (3, "abcX "), (4, None), (5, "zzz")]
    df = spark.createDataFrame(rows, "n int, text string")
    length = lambda t: F.array(F.length(t).cast("double"), F.ascii(F.right(t, F.lit(1))).cast("double"))
    first = {r.n: r.embedding for r in vectors.embed(df, "text", length, prefix=3, order="n").collect()}
    assert first[1] == first[2] == first[3] == [4.0, float(ord("X"))]
    memo = vectors.memo_of(vectors.embed(df.where("n = 5"), "text", lambda t: F.array(F.lit(9.0))), "text")
    got = {r.n: r.embedding for r in vectors.embed(df, "text", length, memo=memo).collect()}
    assert got[5] == [9.0] and got[2] == [4.0, float(ord("A"))] and got[4][0] == 0.0
    told = vectors.memo_stats(df, "text", memo).first()
    assert tuple(told) == (5, 4, 2, 3, 0.4)


def test_pauses_equal_the_stream_of_requests(spark):
    from datetime import datetime, timedelta

    rng = random.Random(4)
    rows = [(layer, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(40_000)), k, rng.random() < 0.7) for k, layer in enumerate(rng.choices("abc", k=900))]
    rows += [("d", datetime(2024, 1, 1, 0, m), 1000 + m, True) for m in (0, 8, 16)] + [(None, datetime(2024, 1, 1), 2000, True)]
    want = {}
    for layer in {r[0] for r in rows}:
        until, failures, refused, pauses = None, 0, 0, 0
        for _, ts, _, failed in sorted((r for r in rows if r[0] == layer and r[3]), key=lambda r: r[1]):
            failures += 1
            if until is not None and ts < until:
                refused += 1
            else:
                pauses, until = pauses + 1, ts + timedelta(minutes=10)
        want[layer] = (failures, refused, pauses)
    assert want["d"] == (3, 1, 2)
    df = spark.createDataFrame(rows, "layer string, ts timestamp, event_id long, failed boolean").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert {r.layer: (r.failures, r.refused, r.pauses) for r in state.pauses_batch(df).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows_get_on():
    text = "a" * 60 + " " + "b" * 400
    found = chunks.char_windows(text, 150, 100)
    assert all(b[0] - a[0] >= 50 for a, b in zip(found, found[1:])) and len(found) == 10


def test_numbers_stay(spark):
    df = spark.range(100).repartition(7).withColumn("k", F.col("id") * 7 % 100)
    got = number_rows(df, ["k"], "n").collect()
    assert all(r.n == r.k for r in got)


def test_options():
    cfg = EngineConfig.from_options({"blocked_domains": "WWW.Foo.com, bar.www.org,,", "trusted_domains": "www.a.com", "early_stop": "Sim", "top_k": "x"})
    assert {"foo.com", "bar.www.org", "facebook.com", "x.com"} <= set(cfg.blocked_domains) and cfg.trusted_domains == ("a.com",) and cfg.early_stop and cfg.top_k == 10
    assert text_list(" a,b ,,a") == ["a", "b"] and domain_list(None) == set() and label_set("Fake News, real-ish") == {"fake_news", "real_ish"}


def test_available_layers(spark):
    rows = [("a", True, False, None), ("b", False, False, None), ("c", True, True, " "), ("d", True, True, "key"), ("e", True, False, None), ("f", None, None, None)]
    df = spark.createDataFrame(rows, "layer string, enabled boolean, needs_key boolean, key string")
    pauses = spark.createDataFrame([("e", "2024-01-01 00:10:00"), ("d", "2023-01-01 00:00:00")], "layer string, until string").withColumn("until", F.to_timestamp("until"))
    now = F.to_timestamp(F.lit("2024-01-01 00:05:00"))
    assert {r.layer for r in retrieve.available_layers(df, pauses, now).where("available").collect()} == {"a", "d", "f"}
    assert {r.layer for r in retrieve.available_layers(df).where("available").collect()} == {"a", "d", "e", "f"}


def test_vector_layer_takes_queries_in_their_order(spark):
    docs = [("1", "gato preto dorme"), ("2", "cachorro late muito"), ("3", "gato cachorro juntos")]
    rows = spark.createDataFrame([(i, t, "s", f"http://{i}.com/x", None, {}, "news") for i, t in docs], "base_doc_id string, text string, source string, url string, published_at string, metadata map<string,string>, source_type string")
    layer = index.vector_layer(index.rows_of(rows))
    asked = spark.createDataFrame([("c", ["cachorro late muito", "gato preto dorme"], "http://z.com/1")], "claim_id string, queries array<string>, article_url string")
    got = [r.text for r in layer(asked, EngineConfig(top_k=3)).orderBy("pos").collect()]
    assert got[0] == docs[1][1] and sorted(got) == sorted(t for _, t in docs) and got.index(docs[0][1]) == 2
    assert [r.text for r in layer(asked, EngineConfig(top_k=1)).collect()] == [docs[1][1]]


def test_damaged_index(spark, tmp_path):
    path = tmp_path / "index"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"not a table")
    assert index.load(spark, str(path)).collect() == []
    row = spark.createDataFrame([("1", "um texto", "s", "http://a.com/x", None, {}, "news")], "base_doc_id string, text string, source string, url string, published_at string, metadata map<string,string>, source_type string")
    index.append(index.rows_of(row), str(path))
    assert [r.base_doc_id for r in index.load(spark, str(path)).collect()] == ["1"]


def test_raw_evidence_and_documents(spark):
    import json

    from attestor.sources import sinks

    claims_ = spark.createDataFrame([(1, "o banco elevou juros"), (2, "nada")], "claim_id long, text string")
    rows = [(1, str(k), s, "news", "news", "o banco elevou juros ontem", "src", "http://u", True) for k, s in enumerate((0.3, 0.9, None, 0.8, 0.7))]
    ev = spark.createDataFrame(rows, "claim_id long, evidence_id string, similarity double, layer string, source_type string, text string, source string, url string, trusted boolean")
    top = stance.for_raw_evidence(stance.prepared(claims_, "text", "claim").drop("text"), stance.prepared(ev, "text", "evidence"))
    assert {r.evidence_id for r in top.collect()} == {"1", "3", "4"}
    judged = stance.pair_stance(top.withColumn("similarity", stance.similarity_of(top)))
    told = {(r.claim_id, r.evidence_id): (r.stance, r.confidence) for r in stance.with_orphans(claims_, judged, 1.0).collect()}
    assert told[2, ""] == ("insufficient", 1.0) and told[1, "1"][0] == "support"
    doc = json.loads(sinks.stance_documents(judged).where("evidence_id = '1'").first().document)
    assert doc["stance"] == "support" and doc["similarity"] == 0.9 and doc["trusted"] is True
    ranked = vectors.rerank(judged.withColumn("semantic", F.lit(0.9)))
    docs = {r.claim_id: json.loads(r.document) for r in sinks.similarity_documents(claims_, ranked).collect()}
    assert docs[2] == {"claim_id": 2, "score": 0.0, "has_sufficient": False, "evidence": []} and [e["rank"] for e in docs[1]["evidence"]] == [0, 1, 2]
    pick = spark.createDataFrame([(" ", None, "x"), (None, None, None)], "a string, b string, c string").select(stance.first_filled(F.col("a"), F.col("b"), F.col("c")).alias("f"))
    assert [r.f for r in pick.collect()] == ["x", ""]


def test_steps(spark):
    steps = timing.Steps(spark)
    assert steps.run("numbers", spark.range(5)).count() == 5
    steps.run("none", spark.range(0))
    rows = [(r["name"], r["rows"]) for r in steps.table().orderBy("step").collect()]
    assert rows == [("numbers", 5), ("none", 0), ("total", None)] and all(r.seconds >= 0 for r in steps.table().collect())


PAGE = """<html><head><title> A  page </title><script>x</script></head><body><nav><p>A navigation paragraph that is long enough to count</p></nav>
<article><h1>A heading that is longer than thirty-five characters</h1><p>Short.</p><p>A paragraph of the <b>article</b> with quite enough text to count.</p>
<ul><li>An item of a list that is long enough to be text too</li></ul></article><p>A paragraph outside of the article, long enough but not read.</p></body></html>"""


def test_crawled_pages(spark):
    title, body = pages.crawl_text(PAGE)
    assert title == "A page" and body == (
        "A heading that is longer than thirty-five characters A paragraph of the article with quite enough text to count. An item of a list that is long enough to be text too"
    )
    assert pages.crawl_text("<p>few words</p><div>more</div>") == ("", "few words more") and pages.crawl_text(None) == ("", "")
    found = [("http://a.com/1", "t1", "s1"), ("http://b.com/2", "t2", "s2"), ("http://c.com/3", "t3", None), ("http://d.com/4", "t4", "s4"), ("http://facebook.com/x", "t", "s"), ("http://a.com/1", "t1", "s1")]
    fetched = [
        ("http://a.com/1", "http://a.com/final", 200, "text/html", PAGE), ("http://b.com/2", None, 404, None, None), ("http://c.com/3", None, 200, "image/png", "x"),
        ("http://d.com/4", "http://x.com/login", 200, "text/html", PAGE),
    ]
    got = {
        r.url: (r.final_url, r.title, r.body[:9])
        for r in pages.crawled_pages(spark.createDataFrame(found, "url string, title string, summary string"), spark.createDataFrame(fetched, "url string, final_url string, status int, content_type string, body string")).collect()
    }
    assert got == {"http://a.com/1": ("http://a.com/final", "A page", "A heading"), "http://b.com/2": ("http://b.com/2", "t2", "s2")}


def test_first_words():
    assert tx.first_words(["de acordo com", "É", "refere-se a"]) == ["de", "refere", "é"]
