import random

import pytest
from pyspark.sql import functions as F

from attestor.config import EngineConfig
from attestor.operators import chunks, claims, clean, features, index, pages, retrieve, score, segment, stance, vectors


def texts(spark, *rows):
    return spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")


# --- segments --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 4, 5, 7, 8, 9])
def test_segments_are_the_sliding_windows(spark, n):
    rows = [(1, 0, i, f"sentence number {i} with some more words here", 8) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, block_index int, sent_index int, text string, token_count int")
    got = segment.number_segments(segment.segments(df)).orderBy("seg_index").collect()
    want = [list(range(s, min(s + 4, n))) for s in range(0, n, 3)]
    want = [w for w in want if 8 * len(w) >= 15]
    assert [r.sent_indexes for r in got] == want and [r.seg_index for r in got] == list(range(len(want)))
    last = {r.sent_index: r.segment_id for r in segment.sentence_segments(df, segment.number_segments(segment.segments(df))).collect()}
    assert last == {i: max((k for k, w in enumerate(want) if i in w), default=None) for i in range(n)}


def test_blocks_and_stats(spark):
    docs = texts(spark, "x" * 39 + "\n" + "Uma frase bem comprida aqui. Outra frase bem comprida aqui.\n\n" + "y" * 50, None, "")
    blocks = segment.blocks(docs)
    assert [(r.doc_id, r.block_index) for r in blocks.collect()] == [(0, 1), (0, 3)]
    sents = segment.sentences(blocks)
    stats = {r.block_index: r for r in segment.block_stats(blocks, sents).collect()}
    assert (stats[1].sentences, stats[1].tokens, stats[1].avg_tokens) == (2, 10, 5.0)
    assert (stats[3].sentences, stats[3].avg_tokens) == (1, 1.0)


# --- claims ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, decision, reason, kind",
    [
        ("curta demais", "reject", "short", None),
        ("Será que o governo vai mesmo aumentar os impostos?", "reject", "question", None),
        ("Bom dia a todos os nossos queridos leitores", "reject", "greeting", None),
        ("Veja como economizar nas compras do mês", "reject", "imperative", None),
        ("Acho que o governo errou nessa decisão", "reject", "opinion", None),
        ("O ministro afirmou que foram 300 casos no estado", "accept", "signals", "quoted"),
        ("O preço subiu 12 reais devido a uma seca forte", "accept", "signals", "causal"),
        ("O valor chegou a 12 reais em março de 2024 no sul", "accept", "signals", "statistical"),
        ("O ministro afirmou que nada vai mudar ali", "ambiguous", "band", None),
        ("Uma frase comum sobre coisas sem maior sinal", "reject", "weak", None),
        ("O índice ficou em 5 % no mês segundo fontes", "reject", "weak", None),
    ],
)
def test_decisions(spark, text, decision, reason, kind):
    row = claims.decide(claims.with_signals(texts(spark, text))).first()
    assert (row.decision, row.reason, row.claim_type) == (decision, reason, kind)


def test_decision_arithmetic_over_all_signal_sets(spark):
    from attestor import lexicons as lx

    names = list(lx.SIGNAL_WEIGHTS)
    rows = []
    for mask in range(1 << len(names)):
        chosen = [n for k, n in enumerate(names) if mask >> k & 1]
        rows.append((chosen, sum(lx.SIGNAL_WEIGHTS[n] for n in chosen), "x" * 30))
    df = spark.createDataFrame(rows, "signals array<string>, points int, text string")
    for r in claims.decide(df).collect():
        s = round(sum(lx.SIGNAL_WEIGHTS[n] for n in r.signals) / 100, 2)
        want = ("accept", min(0.65 + 0.18 * s, 0.93)) if s >= 0.70 else ("ambiguous", 0.5) if s >= 0.30 else ("reject", max(0.60, 0.85 - s))
        assert (r.decision, r.confidence) == (want[0], pytest.approx(want[1]))


def test_resolver(spark):
    rows = claims.decide(claims.with_signals(texts(spark, "O ministro afirmou que nada vai mudar ali", "O ministro afirmou que foram 300 casos no estado")))
    plain = {r.doc_id: (r.is_claim, r.method) for r in claims.resolve(rows).collect()}
    assert plain == {0: (False, "ambiguous"), 1: (True, "heuristic")}
    asked = claims.resolve(rows, lambda df: df.withColumn("resolved", F.lit(True)))
    assert {r.doc_id: (r.is_claim, r.method) for r in asked.collect()} == {0: (True, "resolver"), 1: (True, "heuristic")}


@pytest.mark.parametrize(
    "text, label, confidence",
    [
        ("curta demais", "noise", 1.0),
        ("Quem pagou essa conta toda afinal?", "rhetorical", 0.95),
        ("Clique aqui para saber mais detalhes", "noise", 0.95),
        ("Talvez o clima melhore um pouco amanhã", "opinion", 0.85),
        ("O relatório mostrou alta de 3,5 no preço", "checkable", 0.70),
        ("coisas sem verbo nem nome nem nada aqui", "noise", 0.8),
    ],
)
def test_checkability(spark, text, label, confidence):
    row = claims.checkability(claims.rule_analysis(texts(spark, text))).first()
    assert (row.label, row.label_confidence) == (label, pytest.approx(confidence))


def test_detect_limits_before_it_sorts(spark):
    rows = [(1, 0, i, "texto " * 6, "checkable", 0.3 + 0.001 * i, ["Ana Maria"]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, block_index int, sent_index int, text string, label string, label_confidence double, entities array<string>")
    got = claims.detect(df).orderBy("rank").collect()
    assert [r.sent_index for r in got] == list(range(49, -1, -1))


# --- cleaning, chunks --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("Texto com &amp; entidade e​ zero largura", "Texto com & entidade e zero largura"),
        ("Veja em https://a.com/x?y=1 e www.b.com agora", "Veja em e agora"),
        ("Fale com ana@b.com ou @perfil sobre #tema já", "Fale com ou sobre já"),
        ("Ligue (11) 99999-9999 para saber o preço", "Ligue para saber o preço"),
        ("Identificador 123.456.789-09 e 1234567 saem do texto", "Identificador e saem do texto"),
        ("Nossa!!!! que coisa---- grande??? mesmo", "Nossa! que coisa- grande? mesmo"),
        ("curta\nlinha comprida o bastante\n\n\n\noutra linha comprida", "linha comprida o bastante\n\noutra linha comprida"),
        ("Emoji 😀 sai e o sinal © fica no texto", "Emoji sai e o sinal © fica no texto"),
        (None, None),
    ],
)
def test_clean(spark, text, want):
    assert texts(spark, text).select(clean.clean(F.col("text")).alias("x")).first().x == want


def test_short_lines_lose_only_spaces_at_their_ends(spark):
    lines = ["0997523947200283 begins with the line's number", "  1219538112535716 with spaces around 1  ", "2 lines before 2", "", "short 4"]
    got = texts(spark, "\n".join(lines)).select(clean.drop_short_lines(F.col("text")).alias("x")).first().x
    assert got == "\n".join([lines[0], lines[1].strip(), lines[2], ""])


def test_clean_rendered(spark):
    df = texts(spark, "palavraOutra antes {" + "k:1," * 30 + "} depois de tudo")
    assert df.select(clean.clean(F.col("text"), rendered=True).alias("x")).first().x == "palavra Outra antes depois de tudo"
    assert "palavraOutra" in df.select(clean.clean(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize("text", ["a b " * 199, "a b " * 500, "x" * 2000, "a " + "x" * 900 + " b", ""])
def test_char_windows(text):
    got = chunks.char_windows(text, 800, 100)
    assert all(len(p) <= 800 for _, p in got) and [s for s, _ in got] == sorted({s for s, _ in got})
    covered = set()
    for start, piece in got:
        covered |= set(range(start, start + 800 + 1)) if piece else set()
    assert set(range(len(text))) <= covered
    if len(text) <= 800:
        assert got == [(0, text)]


def slow_pack(blocks, size, most):
    out, current = [], ""
    for b in blocks:
        pieces = [b]
        if len(b) > size:
            pieces, own = [], ""
            for s in [x.strip() for x in __import__("re").split(r"(?<=[.!?])\s+", b) if x.strip()]:
                if len(s) > size:
                    pieces += ([own] if own else []) + [s[i : i + size].strip() for i in range(0, len(s), size)]
                    own = ""
                elif len((own + " " + s).strip()) <= size:
                    own = (own + " " + s).strip()
                else:
                    pieces += [own] if own else []
                    own = s
            pieces += [own] if own else []
        for p in pieces:
            joined = f"{current}\n\n{p}".strip()
            if len(joined) <= size:
                current = joined
            else:
                out += [current] if current else []
                current = p
    return (out + ([current] if current else []))[:most]


def test_packed(spark):
    rng = random.Random(2)
    cfg = EngineConfig(chunk_chars=60, max_chunks=5)
    rows = []
    for _ in range(40):
        rows.append([" ".join("w" * rng.randint(1, 9) + rng.choice(["", "", "."]) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(0, 6))])
    df = spark.createDataFrame([(r,) for r in rows], "blocks array<string>")
    for r in df.select("blocks", chunks.packed(F.col("blocks"), cfg).alias("p")).collect():
        assert all(len(p) <= 60 for p in r.p) and len(r.p) <= 5
        if all(len(b) <= 60 for b in r.blocks):
            assert r.p == slow_pack(r.blocks, 60, 5)


# --- features ----------------------------------------------------------------------------------------------------------


def test_features_of_sensational_and_sober_texts(spark):
    loud = "URGENTE!!! Bomba chocante: você não vai acreditar no escândalo. " * 4
    sober = "Segundo o relatório do censo, a taxa caiu para 5 em 2024, informou o instituto em nota oficial à imprensa nesta semana. " * 3
    rows = features.with_risk(features.with_features(features.text_stats(texts(spark, loud, sober, "curto", None)))).orderBy("doc_id").collect()
    assert rows[0].risk_label in ("attention", "high") and rows[0].risk > 2 * rows[1].risk and rows[1].risk_label == "low" and rows[0].n_clickbait == 4
    assert rows[2].status == rows[3].status == "empty" and rows[0].status == "ok"
    assert "sensational_language" in rows[0].flags and "verifiable_content" in rows[1].flags
    assert rows[1].readability == 1.0 and rows[3].char_count == 0
    for r in rows:
        assert 0 <= r.risk <= 1 and r.text_score == pytest.approx(1 - r.risk)


# --- retrieval -----------------------------------------------------------------------------------------------------------


def candidate(i, url, text="x" * 60, sim=0.5, layer="gdelt", trusted=False, source_type="news", claim="c"):
    return (claim, i, url, text, sim, layer, trusted, 0, source_type)


CANDIDATE = "claim_id string, evidence_id string, url string, text string, similarity double, layer string, trusted boolean, pos int, source_type string"


def test_ranking(spark):
    rows = [
        candidate("a", "http://x/1", layer="wikipedia", sim=0.9),
        candidate("b", "http://x/2", layer="gdelt", sim=0.5),
        candidate("c", "http://x/2", layer="vector_store", sim=0.3),  # the earlier layer stays, not the better score
        candidate("d", "http://x/3", layer="gdelt", sim=0.11),
        candidate("e", "http://x/4", text="short"),
        candidate("f", "http://x/5", layer="serp_search", sim=0.5, trusted=True),
        candidate("g", "", text="Same Start " * 20), candidate("h", None, text="same start " * 20, layer="crawlee_search"),
    ]
    got = retrieve.rank_evidence(spark.createDataFrame(rows, CANDIDATE)).orderBy("rank").collect()
    assert [r.evidence_id for r in got] == ["g", "f", "c", "a"]
    assert [round(r.rank_score, 4) for r in got] == [0.4, 0.39, 0.3, 0.18]


def test_layers_run_in_order_and_the_last_resort_only_for_unfilled_claims(spark):
    asked = {}

    def layer(name, sim, only=None):
        def search(claims_, cfg):
            asked[name] = sorted(r.claim_id for r in claims_.collect())
            ids = [c for c in asked[name] if only is None or c in only]
            return spark.createDataFrame([candidate("", f"http://{name}/{c}", sim=sim, claim=c) for c in ids], CANDIDATE).drop("evidence_id")

        return search

    found = spark.createDataFrame([("c1",), ("c2",)], "claim_id string")
    layers = {"wikipedia": layer("wikipedia", 0.9), "ai_fallback": layer("ai_fallback", 0.6), "gdelt": layer("gdelt", 0.8, {"c1"})}
    got = retrieve.retrieve(found, layers)
    assert asked == {"gdelt": ["c1", "c2"], "ai_fallback": ["c2"], "wikipedia": ["c1", "c2"]}
    assert {(r.claim_id, r.layer) for r in got.collect()} == {("c1", "gdelt"), ("c2", "ai_fallback"), ("c1", "wikipedia"), ("c2", "wikipedia")}


def test_pair_predicates(spark):
    rows = [
        ("O Banco Central elevou a taxa para 13%", "O Banco Central do Brasil elevou ontem a taxa básica para 13 por cento ao ano", ["Banco Central"], "http://a.com", True),
        ("O Banco Central elevou a taxa para 13%", "O Banco Central do Brasil elevou ontem a taxa básica para 14 por cento ao ano", ["Banco Central"], "http://a.com", False),
        ("O Banco Central elevou a taxa hoje", "A taxa que elevou preços não tem qualquer relação com bancos, dizem analistas", ["Casa Branca"], "http://a.com", False),
        ("O Banco Central elevou a taxa hoje", "O Banco Central elevou a taxa hoje, e o texto é comprido o bastante", [], "http://m.x.com", False),
    ]
    df = spark.createDataFrame(rows, "claim_text string, evidence_text string, entities array<string>, url string, want boolean")
    df = retrieve.prepared(retrieve.prepared(df, "claim_text", "claim"), "evidence_text", "evidence")
    assert all(r.ok == r.want for r in df.select("want", retrieve.relevant(df, url="url", entities="entities").alias("ok")).collect())


# --- stance and score ------------------------------------------------------------------------------------------------------

BASE = "governo aprovou reforma tributaria congresso nacional ontem"


@pytest.mark.parametrize(
    "claim, evidence, sim, layer, want, confidence",
    [
        (BASE, "", 0.9, "gdelt", "insufficient", 1.0),
        (BASE, BASE, 0.54, "gdelt", "insufficient", 0.85),
        (BASE, BASE, 0.9, "wikipedia", "neutral", 0.60),
        (BASE + " 10%", BASE + " 20%", 0.9, "gdelt", "contradict", 0.78),
        (BASE, BASE + " e boato", 0.9, "gdelt", "contradict", 0.70),
        (BASE, "nao " + BASE, 0.9, "gdelt", "contradict", 0.64),
        (BASE, BASE, 0.8, "gdelt", "support", 0.88),
        (BASE, "governo congresso outra coisa bem diversa mesmo", 0.72, "gdelt", "support", 0.66),
        (BASE, "governo congresso outra coisa bem diversa mesmo", 0.6, "gdelt", "neutral", 0.58),
        (BASE, "nada em comum aqui", 0.6, "gdelt", "insufficient", 0.75),
    ],
)
def test_stance_rules(spark, claim, evidence, sim, layer, want, confidence):
    df = spark.createDataFrame([(claim, evidence, sim, layer, "news")], "c string, e string, similarity double, layer string, source_type string")
    row = stance.pair_stance(stance.prepared(stance.prepared(df, "c", "claim"), "e", "evidence")).first()
    assert (row.stance, row.confidence) == (want, pytest.approx(confidence))


@pytest.mark.parametrize(
    "evidence, coverage, reputation, classifier, support, contradiction, want, label",
    [
        (0.8, 1.0, 0.9, None, 0.9, 0.4, 82.94, "unreliable"),
        (0.0, 0.0, 0.9, None, 0.0, 0.0, 26.47, "insufficient_evidence"),
        (0.0, 0.0, 0.4, None, 0.0, 0.0, 11.76, "unverified"),
        (0.8, 0.1, 0.4, None, 0.9, 0.0, 17.41, "insufficient_evidence"),
        (1.0, 1.0, 0.4, None, 0.9, 0.0, 82.35, "reliable"),
        (1.0, 1.0, 0.4, None, 0.5, 0.0, 82.35, "partially_reliable"),
        (0.6, 0.3, 0.4, 0.5, 0.5, 0.0, 28.3, "partially_reliable"),
    ],
)
def test_final_score(spark, evidence, coverage, reputation, classifier, support, contradiction, want, label):
    names = "evidence_score double, coverage double, reputation double, classifier double, support_rate double, contradiction_rate double"
    row = score.final_score(spark.createDataFrame([(evidence, coverage, reputation, classifier, support, contradiction)], names)).first()
    assert (row.score, row.label) == (pytest.approx(want, abs=0.02), label)


def test_weighted_probability(spark):
    rows = [("a", "real", 0.9, 100), ("a", "real", 0.5, 300), ("b", "fake", 0.8, 10), ("c", "real", 0.5, 0), ("c", "fake", 0.5, 0)]
    got = {r.doc: r for r in score.weighted_probability(spark.createDataFrame(rows, "doc string, label string, score double, weight int"), "doc").collect()}
    assert (got["a"].real_probability, got["a"].fake_probability, got["a"].label) == (0.6, 0.4, "reliable")
    assert (got["b"].real_probability, got["b"].label) == (0.2, "unreliable") and got["c"].label == "undefined"


# --- pages, vectors, index ----------------------------------------------------------------------------------------------------

LONG = "Um parágrafo comprido o bastante para contar como bloco de texto, com palavras de sobra e um fim. "


def test_page_with_article():
    source = f"""<html><head><title>Titulo | Portal</title><meta property="og:description" content="Resumo &amp; mais"></head><body><nav><p>{LONG}</p></nav>
      <article><h1>O título</h1><p>{LONG}1<p>{LONG}2</p><p>curto</p><div class="ad-box"><p>{LONG}3</p></div><p>{LONG}1</p></article>
      <p>{LONG}fora</p><script>var x = "<p>{LONG}</p>"</script></body></html>"""
    page = pages.read_page(source)
    assert page["title"] == "O título" and page["description"] == "Resumo & mais"
    assert [b[-1] for b in page["blocks"]] == ["2", "1"] or [b[-1] for b in page["blocks"]][0] in "12"
    assert not any("fora" in b or b.endswith("3") for b in page["blocks"])


def test_page_fall_backs_and_signals():
    portal = pages.read_page('<div class="post-content">' + "".join(f"<p>{LONG}{k}</p>" for k in range(4)) + "</div>" + f"<p>{LONG}x</p>")
    assert [b[-1] for b in portal["blocks"]] == ["0", "1", "2", "3"]
    plain = pages.read_page(f"<title>A - B</title><p>{LONG}x</p>")
    assert (plain["title"], len(plain["blocks"])) == ("A", 1)
    wall = pages.read_page('<div id="app"></div><p>Assine para continuar lendo</p>')
    assert wall["paywall"] and wall["scripted"] and wall["blocks"] == []
    assert pages.read_page(None)["title"] == ""


def test_articles_filter_addresses_and_choose_rendering(spark):
    rows = [(1, "https://a.com/x", "<p>" + LONG + "</p>"), (2, "ftp://a.com", ""), (3, "https://www.facebook.com/x", ""), (4, "https://b.com", "")]
    static = pages.articles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.warnings for r in static.collect()} == {1: [], 4: ["empty"]}
    rendered = pages.articles(spark.createDataFrame([(4, "https://b.com", "<p>" + LONG + "</p>"), (1, "https://a.com/x", "")], "page_id long, url string, html string"))
    best = {r.page_id: r.render_method for r in pages.better(static, rendered).collect()}
    assert best == {1: "static", 4: "rendered"}


@pytest.mark.parametrize("values", [10**9, 4])
def test_knn(spark, monkeypatch, values):
    monkeypatch.setattr(vectors, "PASS_VALUES", values)
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.8, 0.6]), (2, 1, [0.6, 0.8]), (3, 1, [0.6, 0.8]), (4, 2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, base_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding").where("vec_id in (0, 4)")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in vectors.knn(df, asked, 2, 0.5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 0, 1), (0, 2, 2), (4, 4, 1)]


def test_rerank_limits(spark):
    rows = [("c", f"e{k:02}", 0.5, k / 20) for k in range(20)]
    got = vectors.rerank(spark.createDataFrame(rows, "claim_id string, evidence_id string, similarity double, semantic double")).orderBy("rank").collect()
    assert len(got) == 10 and got[0].evidence_id == "e19" and [r["rank"] for r in got] == list(range(10))
    assert all(r.is_sufficient == (r.final >= 0.55) for r in got)


def test_index_append_delete_and_gate(spark, tmp_path):
    docs = spark.createDataFrame([("a", "palavra " * 300, "s", "http://a", None, {"k": "v"}, "news"), ("b", "outra coisa", "t", "http://b", None, None, "news")],
        "base_doc_id string, text string, source string, url string, published_at string, metadata map<string,string>, source_type string")
    path = str(tmp_path / "index")
    assert index.load(spark, path).count() == 0
    index.append(index.rows_of(docs), path)
    held = index.load(spark, path)
    assert {(r.source, r.chunks, r.documents) for r in index.stats(held).collect()} == {("s", held.where("source = 's'").count(), 1), ("t", 1, 1)}
    assert held.where("base_doc_id = 'a'").count() > 2 and held.select("vec_id").distinct().count() == held.count()
    left = index.numbered(index.delete(held, spark.createDataFrame([("a",)], "base_doc_id string")))
    assert [(r.base_doc_id, r.position) for r in left.collect()] == [("b", 0)]
    layer = index.vector_layer(held)
    asked = spark.createDataFrame([("c", "outra coisa", "http://z"), ("d", "outra coisa", "http://b")], "claim_id string, query string, article_url string")
    assert {(r.claim_id, r.url) for r in layer(asked, EngineConfig()).collect()} == {("c", "http://b")}
