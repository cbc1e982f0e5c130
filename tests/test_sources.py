import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from attestor.config import EngineConfig
from attestor.sources import fetch, layers, seeds, sinks

CLAIM = "O Banco Central elevou a taxa básica de juros"
GOOD = "Banco Central elevou ontem a taxa básica de juros pela terceira vez seguida no ano"


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame([("c", CLAIM, ["Banco Central"], "http://own.com/a")], "claim_id string, text string, entities array<string>, article_url string")


BODIES = {
    "factcheck": {"claims": [{"text": "x", "claimReview": [{"publisher": {"name": "P"}, "title": "T", "url": "http://f.com/1", "textualRating": "Falso"}, {"url": ""}]}]},
    "web_search": {"web": {"results": [{"title": "T", "url": "http://bbc.com/1", "description": GOOD}, {"title": "T", "url": "http://u.com/1", "description": GOOD}]}},
    "tavily_search": {"results": [{"title": "T", "url": "http://t.com/1", "content": GOOD, "score": 0.5}, {"title": "T", "url": "http://t.com/1", "content": GOOD}, {"url": "http://own.com/a", "content": GOOD}]},
    "serp_search": {"organic": [{"title": "T", "link": "http://s.com/1", "snippet": GOOD, "position": 1}, {"title": "T", "link": "http://s.com/2", "snippet": "nada a ver com o tema"}]},
    "gdelt": {"articles": [{"url": "http://g.com/1", "title": GOOD, "seendate": "2024"}]},
    "newsapi": {"articles": [{"url": "http://n.com/1", "title": "T", "description": GOOD, "source": {"name": "N"}, "publishedAt": "2024"}]},
    "wikipedia": {"title": "W", "extract": GOOD, "content_urls": {"desktop": {"page": "http://w.org/1"}}},
    "ai_fallback": {"candidates": [{"content": {"parts": [{"text": "```json\n" + json.dumps({"found": True, "url": "http://m.com/1", "text": GOOD, "confidence": 0.9}) + "\n```"}]}}]},
}


@pytest.mark.parametrize("name", BODIES)
def test_layers(spark, claims, name):
    rows = [("c", name, "q", 200, "application/json", json.dumps(BODIES[name])), ("c", name, "q", 429, "application/json", json.dumps(BODIES[name]))]
    rows += [("c", name, "q", 200, "text/html", "<html>"), ("c", name, "q", 200, "application/json", "{broken"), ("c", name, "q", 200, None, None)]
    stored = spark.createDataFrame(rows, "claim_id string, layer string, query string, status int, content_type string, body string")
    got = layers.candidates(name, stored, claims, trusted=("bbc.com",)).collect()
    assert len(got) == 1 and got[0].url.endswith("/1") and 0 < got[0].similarity <= 1
    assert got[0].trusted == (name in ("factcheck", "web_search"))
    assert [tuple(r) for r in layers.refused(stored).collect()] == [(name, 429, 1)]


@pytest.mark.parametrize("text, found", [('{"found": true}', "true"), ('Sure: {"found": true} ok', "true"), ("no idea", "false"), ("```\n{\"found\": false}\n```", "false")])
def test_model_replies(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.get_json_object(layers.json_text(F.col("t")), "$.found").alias("f")).first().f == found


def test_seed_files(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\n\nhttp://a.com/1\n http://b.com/2 \nhttp://a.com/1\n")
    rows = seeds.seed_urls(spark, str(tmp_path / "urls.txt"))
    assert sorted(r.url for r in rows.collect()) == ["http://a.com/1", "http://b.com/2"]
    assert [r.url for r in seeds.trusted_only(rows, spark.createDataFrame([("a.com",)], "domain string")).collect()] == ["http://a.com/1"]


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "true").mkdir()
    for k in range(4):
        (tmp_path / "true" / f"{k}.txt").write_text("Uma linha comprida de texto para o corpus. " * (1 if k == 1 else 5))
    (tmp_path / "meta.csv").write_text("id,author\n0,Ana\n3.txt,Eva\n")
    folder = seeds.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "empty"), str(tmp_path / "true")])
    assert folder == str(tmp_path / "true")
    rows = seeds.corpus_folder(spark, folder, str(tmp_path / "meta.csv"), files=3).collect()
    assert {(r.stem, r.author) for r in rows} == {("0", "Ana"), ("2", None)}


def test_feeds(spark):
    rss = "<rss><channel>" + "".join(f"<item><title>T{k}</title><link>http://a.com/{k}</link><description>D</description></item>" for k in range(7)) + "</channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="http://a.com/0/"/></entry></feed>'
    page = '<a href="http://r.com/?url=http%3A%2F%2Fc.com%2Fz">Go</a><a href="/rel">no</a><a href="http://x.com/b">blocked</a>'
    rows = spark.createDataFrame([("q", 0, rss), ("q", 1, atom), ("q", 2, page), ("p", 0, None)], "query string, seed int, body string")
    got = seeds.feed_rows(rows, ("x.com",)).orderBy("seed", "pos").collect()
    assert [r.url for r in got] == [f"http://a.com/{k}" for k in range(5)] + ["http://c.com/z"]
    addresses = seeds.seed_addresses(spark.createDataFrame([("a b",)], "query string"), ["http://s/?q={query}", "http://s/?q={query}"])
    assert [r.address for r in addresses.collect()] == ["http://s/?q=a+b"]


class _Answer(io.BytesIO):
    status = 200

    def __init__(self, body):
        super().__init__(body)
        self.headers = __import__("email.message").message.Message()
        self.headers["Content-Type"] = "text/html; charset=utf-8"

    def geturl(self):
        return "http://final"


def test_fetch_retries():
    calls = []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 429, "slow down", None, None)
        return _Answer("olá".encode())

    assert fetch.fetch("http://a", wait=0, opener=opener)[1:5] == ("http://final", 200, "text/html; charset=utf-8", "olá")

    def gone(request, timeout):
        calls.append("gone")
        raise urllib.error.HTTPError(request.full_url, 404, "gone", None, None)

    del calls[:]
    row = fetch.fetch("http://a", wait=0, opener=gone)
    assert row[2] == 404 and calls == ["gone"] and row[4] is None
    assert fetch.fetch("no url", wait=0)[5]


def test_data_source(spark):
    spark.dataSource.register(fetch.HttpPages)
    rows = spark.read.format("http_pages").option("urls", "bad one\nbad two").option("tries", 1).load().collect()
    assert [(r.url, r.status, r.body) for r in rows] == [("bad one", None, None), ("bad two", None, None)]


def test_sinks(spark, tmp_path):
    evidence = spark.createDataFrame([("c", 1, "e1", "http://a", "s", "gdelt", 0.51239, "support", "t" * 500, True, "news", None), ("c", 0, "e0", "http://b", "s", "gdelt", 0.6, None, "u", False, "news", "2024")],
        "claim_id string, rank int, evidence_id string, url string, source string, layer string, similarity double, stance string, text string, trusted boolean, source_type string, published_at string")
    articles = spark.createDataFrame([(1, "T"), (2, "U")], "doc_id long, title string")
    claims_ = spark.createDataFrame([("c", 1, "claim")], "claim_id string, doc_id long, text string")
    scores = spark.createDataFrame([(1, 50.0)], "doc_id long, score double")
    docs = sinks.nested_documents(articles, claims_, evidence, scores)
    got = {r.doc_id: json.loads(r.document) for r in docs.collect()}
    assert [e["evidence_id"] for e in got[1]["claims"][0]["evidence"]] == ["e0", "e1"] and len(got[1]["claims"][0]["evidence"][1]["text"]) == 200
    assert got[1]["score"] == 50.0 and "claims" not in got[2]
    sinks.write_json(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert sinks.evidence_payload(evidence).where("id = 'e1'").first().similarity_score == 0.5124
    assert sinks.retrieval_payload(evidence).first().layers_used == ["gdelt"]


def test_config():
    cfg = EngineConfig.from_options({"top_k": "5", "semantic_weight": "bad", "trusted_domains": "www.A.com, b.com", "early_stop": "Sim"})
    assert (cfg.top_k, cfg.semantic_weight, cfg.trusted_domains, cfg.early_stop) == (5, 0.7, ("a.com", "b.com"), True)


def test_feed_articles(spark):
    from attestor.sources import seeds

    para = "<p>Um parágrafo comprido o bastante para ser um bloco de texto inteiro, com assunto.</p>"
    html = lambda n: "<article>" + "".join(para.replace("assunto", f"assunto {k}") for k in range(n)) + "</article>"
    pages = spark.createDataFrame([(k, f"http://f.com/{k}", html(6 if k != 2 else 1)) for k in range(5)], "page_id long, url string, html string")
    entries = spark.createDataFrame([("f1", k, f"http://f.com/{k}", f"T{k}") for k in range(4)] + [("f2", 0, "http://f.com/0", "again"), ("f2", 1, "http://f.com/4", "T4"), ("f2", 2, " ", "")], "feed string, pos int, url string, title string")
    got = {r.base_doc_id: (r.metadata["title"], r.source_type) for r in seeds.feed_articles(entries, pages, per_feed=3).collect()}
    assert got == {"0": ("T0", "rss_news"), "1": ("T1", "rss_news"), "4": ("T4", "rss_news")}


def test_search_providers_and_titles(spark):
    from attestor.sources import layers

    settings = lambda rows: spark.createDataFrame(rows, "provider string, enabled boolean, key string")
    assert layers.serp_provider(settings([("serper", True, "YOUR_KEY_HERE"), ("serpapi", True, "k"), ("searchapi", True, "k")])).first().provider == "serpapi"
    assert layers.serp_provider(settings([("serper", False, "k")])).first().provider == "searchapi"
    queries = spark.createDataFrame([("c", "q")], "claim_id string, query string")
    made = layers.serp_requests(queries, layers.serp_provider(settings([("serper", True, "k")]))).first()
    assert made.method == "POST" and made.params["q"] == "q" and "engine" not in made.params
    claims = spark.createDataFrame([("c", "texto", ["A", "B", "C", "D"]), ("d", "a", ["A"])], "claim_id string, text string, entities array<string>")
    asked = {(r.claim_id, r.pos): r["query"] for r in layers.title_requests(claims).collect()}
    assert asked == {("c", 0): "A", ("c", 1): "B", ("c", 2): "C", ("c", 3): "texto", ("d", 0): "A"}
    body = '["A", ["T1", "T2", "T3"], [], []]'
    rows = [("c", "wikipedia", "A", 200, "application/json", body), ("c", "wikipedia", "B", 200, "application/json", '["B", ["T1"]]'), ("c", "wikipedia", "C", 429, "application/json", body)]
    got = layers.titles(spark.createDataFrame(rows, "claim_id string, layer string, query string, status int, content_type string, body string")).collect()
    assert {(r["query"], r.title) for r in got} == {("A", "T1"), ("A", "T2")}


def test_proposed_sources_must_answer(spark):
    import json

    from attestor.sources import layers

    text = "O Banco Central elevou a taxa básica de juros na reunião de ontem, segundo nota"
    said = lambda url: json.dumps({"candidates": [{"content": {"parts": [{"text": json.dumps({"found": True, "url": url, "text": text, "title": "t", "source": "s", "relation": "support", "confidence": 0.9})}]}}]})
    rows = [(c, "ai_fallback", "q", 200, "application/json", said(u)) for c, u in (("a", "http://ok.com/1"), ("b", "http://gone.com/2"), ("c", "ftp://x.com/3"))]
    found = spark.createDataFrame(rows, "claim_id string, layer string, query string, status int, content_type string, body string")
    claims = spark.createDataFrame([(c, "Banco Central elevou a taxa básica de juros", [], "http://own.com") for c in "abc"], "claim_id string, text string, entities array<string>, article_url string")
    statuses = spark.createDataFrame([("http://ok.com/1", 200), ("http://gone.com/2", 404)], "url string, status int")
    assert [r.claim_id for r in layers.candidates("ai_fallback", found, claims, statuses=statuses).collect()] == ["a"]
    assert {r.claim_id for r in layers.candidates("ai_fallback", found, claims).collect()} == {"a", "b"}
