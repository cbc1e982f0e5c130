"""Search layers as relations: stored responses of search services become candidate evidence.

A response is a row ``claim_id, layer, query, status, content_type, body``. Who fetches it (see fetch.py) is a matter
apart; here bodies are parsed with explicit schemas, guarded and mapped to one row contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as tx
from ..functions import urls
from ..functions.numbers import clamp, lexical_overlap, round_at
from ..operators import retrieve

#: Where each service's items are, what their fields are called, and of which kind they are.
SCHEMAS = {
    "factcheck": "claims array<struct<text:string,claimDate:string,claimReview:array<struct<publisher:struct<name:string>,title:string,url:string,textualRating:string,reviewDate:string>>>>",
    "web_search": "web struct<results:array<struct<title:string,url:string,description:string>>>",
    "tavily_search": "results array<struct<title:string,url:string,content:string,score:double>>",
    "serp_search": "organic array<struct<title:string,link:string,url:string,snippet:string,position:int>>, organic_results array<struct<title:string,link:string,url:string,snippet:string,position:int>>",
    "gdelt": "articles array<struct<url:string,title:string,domain:string,source:string,seendate:string,language:string,sourcecountry:string>>",
    "newsapi": "articles array<struct<title:string,description:string,content:string,url:string,publishedAt:string,author:string,source:struct<id:string,name:string>>>",
    "wikipedia": "title string, extract string, description string, content_urls struct<desktop:struct<page:string>>",
    "ai_fallback": "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>",
}
ANSWER = "found boolean, url string, text string, title string, source string, relation string, confidence double"
FACT_CHECK_SIMILARITY, MIN_ANSWER_CONFIDENCE, SUMMARY_CHARS = 0.75, 0.45, 800


def usable(responses: DataFrame) -> DataFrame:
    """Responses below status 400 with a body that is, or looks like, JSON."""
    body = F.coalesce("body", F.lit(""))
    like_json = F.lower(F.coalesce("content_type", F.lit(""))).contains("json") | body.rlike(r"^\s*[\[{]")
    return responses.where((F.col("status") < 400) & (F.trim(body) != "") & like_json)


def refused(responses: DataFrame) -> DataFrame:
    """``layer, status, n``: responses that were not usable, for layers_failed and the circuit breaker."""
    return responses.where("status >= 400").groupBy("layer", "status").agg(F.count(F.lit(1)).alias("n"))


def _text(c) -> Column:
    return tx.squeeze(F.coalesce(c, F.lit("")))


def _filled(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def _items(layer: str, responses: DataFrame) -> DataFrame:
    rows = usable(responses).where(F.col("layer") == layer).withColumn("j", F.from_json("body", SCHEMAS[layer])).where("j is not null")
    one = {
        "web_search": "j.web.results", "tavily_search": "j.results", "gdelt": "j.articles", "newsapi": "j.articles", "factcheck": "j.claims",
    }
    if layer == "serp_search":
        return rows.select("claim_id", "query", F.posexplode(F.coalesce("j.organic", "j.organic_results")).alias("pos", "x"))
    if layer in one:
        return rows.select("claim_id", "query", F.posexplode(one[layer]).alias("pos", "x"))
    return rows.select("claim_id", "query", F.lit(0).alias("pos"), F.col("j").alias("x"))


def _mapped(layer: str, responses: DataFrame) -> DataFrame:
    """``claim_id, query, pos, url, title, text, source, source_type, published_at, metadata`` of a layer's items."""
    rows = _items(layer, responses)
    none = F.lit(None).cast("string")
    x = lambda name: F.col(f"x.{name}")
    domain = urls.domain(F.coalesce(x("url"), F.lit(""))) if layer not in ("wikipedia", "ai_fallback", "factcheck") else None
    if layer == "factcheck":
        rows = rows.select("claim_id", "query", "pos", "x", F.posexplode("x.claimReview").alias("k", "r"))
        claim, title = _text(x("text")), F.coalesce(F.nullif(F.col("r.title"), F.lit("")), x("text"))
        rating = F.coalesce("r.textualRating", F.lit(""))
        parts = _filled(claim, F.when(rating != "", F.concat(F.lit("Classificação da checagem: "), rating)).otherwise(""), F.when(title != "", F.concat(F.lit("Título da checagem: "), title)).otherwise(""))
        made = (F.col("r.url"), title, parts, F.coalesce(F.nullif(F.col("r.publisher.name"), F.lit("")), F.lit("fact check")), "fact_check", F.coalesce("r.reviewDate", x("claimDate")), F.create_map(F.lit("rating"), rating))
        pos = F.col("pos") * 1000 + F.col("k")
    elif layer == "web_search":
        made = (x("url"), x("title"), _text(F.concat(_text(x("title")), F.lit(". "), x("description"))), domain, "web", none, F.create_map(F.lit("snippet"), x("description")))
    elif layer == "tavily_search":
        made = (x("url"), _text(x("title")), _text(F.concat(_text(x("title")), F.lit(". "), x("content"))), domain, "web", none, F.create_map(F.lit("score"), x("score").cast("string")))
    elif layer == "serp_search":
        link = F.coalesce(F.nullif(x("link"), F.lit("")), x("url"))
        made = (link, _text(x("title")), _text(F.concat(_text(x("title")), F.lit(". "), x("snippet"))), urls.domain(link), "web", none, F.create_map(F.lit("position"), x("position").cast("string")))
    elif layer == "gdelt":
        source = F.coalesce(F.nullif(x("source"), F.lit("")), F.nullif(domain, F.lit("")), F.nullif(x("domain"), F.lit("")), F.lit("news"))
        seen = F.coalesce(x("seendate"), F.lit("data não informada"))
        made = (x("url"), _text(x("title")), F.concat(_text(x("title")), F.lit(". Fonte: "), source, F.lit(". Publicado/observado em: "), seen, F.lit(".")), source, "news", x("seendate"), F.create_map(F.lit("language"), x("language")))
    elif layer == "newsapi":
        parts = F.array_join(F.filter(F.array(_text(x("title")), _text(x("description")), _text(x("content"))), lambda p: p != ""), ". ")
        made = (x("url"), _text(x("title")), parts, F.coalesce(F.nullif(x("source.name"), F.lit("")), F.nullif(domain, F.lit("")), F.lit("news")), "news", x("publishedAt"), F.create_map(F.lit("author"), x("author")))
    elif layer == "wikipedia":
        full = _text(x("extract"))
        cut = F.when(F.length(full) > SUMMARY_CHARS, F.concat(F.substring(full, 1, SUMMARY_CHARS), F.lit("..."))).otherwise(full)
        rows = rows.where(F.length(full) >= 50)
        made = (x("content_urls.desktop.page"), x("title"), cut, F.lit("encyclopedia"), "encyclopedia", none, F.create_map(F.lit("description"), x("description")))
    elif layer == "ai_fallback":
        said = F.array_join(F.transform(F.flatten(F.transform(x("candidates"), lambda c: c["content"]["parts"])), lambda p: p["text"]), "\n")
        answer = F.from_json(json_text(said), ANSWER)
        rows = rows.withColumn("a", answer).where(F.col("a.found") & (F.coalesce("a.confidence", F.lit(0.0)) >= MIN_ANSWER_CONFIDENCE))
        source = F.coalesce(F.nullif(_text(F.col("a.source")), F.lit("")), urls.domain(F.col("a.url")))
        made = (_text(F.col("a.url")), _text(F.col("a.title")), _text(F.col("a.text")), source, "ai_retrieved_web", none, F.create_map(F.lit("relation"), F.col("a.relation")))
    else:
        raise ValueError(f"no mapping for {layer}")
    names = ("url", "title", "text", "source", "source_type", "published_at", "metadata")
    pos = pos if layer == "factcheck" else F.col("pos")
    return rows.select("claim_id", "query", pos.cast("int").alias("pos"), *[(F.lit(c) if isinstance(c, str) else c).alias(n) for n, c in zip(names, made)])


#: Search services of one layer in the order in which they are preferred, and where their items are.
SERP_PROVIDERS = {"serper": "organic", "serpapi": "organic_results", "searchapi": "organic_results"}


def serp_provider(settings: DataFrame) -> DataFrame:
    """``provider``: the first service of SERP_PROVIDERS that is enabled and has a key (``provider, enabled, key``), else
    the last; one row."""
    order = F.array(*[F.lit(p) for p in SERP_PROVIDERS])
    fit = F.col("enabled") & ~F.lower(F.trim(F.coalesce("key", F.lit("")))).isin("", *PLACEHOLDERS)
    place = F.when(fit, F.array_position(order, F.col("provider")))
    return settings.agg(F.coalesce(F.min(F.when(place > 0, place)), F.lit(len(SERP_PROVIDERS))).alias("k")).select(F.element_at(order, F.col("k").cast("int")).alias("provider"))


#: Texts that stand for a key that was never set.
PLACEHOLDERS = ("sua_chave_aqui", "your_key_here")


def serp_requests(queries: DataFrame, provider: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``claim_id, provider, method, params``: each query (``claim_id, query``) as the chosen service takes it; keys are
    added by whoever sends it."""
    common = [F.lit("q"), F.col("query"), F.lit("gl"), F.lit("br"), F.lit("hl"), F.lit("pt-br"), F.lit("num"), F.lit(str(min(cfg.top_k, 10)))]
    posted = F.col("provider") == "serper"
    params = F.when(posted, F.create_map(*common)).otherwise(F.create_map(*common, F.lit("engine"), F.lit("google")))
    return queries.crossJoin(F.broadcast(provider)).select("claim_id", "provider", F.when(posted, "POST").otherwise("GET").alias("method"), params.alias("params"))


def title_requests(claims: DataFrame, names: int = 3, limit: int = 2) -> DataFrame:
    """``claim_id, pos, query, limit``: an encyclopedia's title search for up to ``names`` entities of a claim, then for
    the claim itself; each spelling once."""
    asked = tx.distinct_by(F.filter(F.concat(F.slice("entities", 1, names), F.array("text")), lambda q: F.trim(q) != ""), F.lower)
    return claims.select("claim_id", F.posexplode(asked).alias("pos", "query"), F.lit(limit).alias("limit"))


def titles(responses: DataFrame, limit: int = 2) -> DataFrame:
    """``claim_id, query, pos, title``: the first ``limit`` titles that a title search (``claim_id, query, status, body``)
    suggests, each once for a claim; their summaries are what the layer reads."""
    own = usable(responses).select("claim_id", "query", F.from_json(F.get_json_object("body", "$[1]"), "array<string>").alias("t"))
    rows = own.select("claim_id", "query", F.posexplode(F.slice("t", 1, limit)).alias("pos", "title")).where("trim(title) <> ''")
    return rows.groupBy("claim_id", "title").agg(F.min(F.struct("query", "pos")).alias("m")).select("claim_id", "m.query", "m.pos", "title")


def json_text(said: Column) -> Column:
    """A model's reply as JSON text: without code fences, else its first braced part, else not found."""
    bare = F.trim(F.regexp_replace(said, r"^\s*```(?:json)?|```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(bare, "$.found").isNotNull(), bare).when(inner != "", inner).otherwise(F.lit('{"found": false}'))


def candidates(
    layer: str, responses: DataFrame, claims: DataFrame, cfg: EngineConfig = DEFAULT, *, trusted: tuple[str, ...] = (), statuses: DataFrame | None = None
) -> DataFrame:
    """A layer's candidate evidence for ``claims`` (``claim_id, text, entities``, ``article_url``): items with address and
    text, each address once, not the claim's own article, relevant, scored, ``top_k`` of a claim in the service's order.
    Fact checks have a fixed similarity and need no relevance test; an encyclopedia is scored by lexical overlap only;
    web search takes trusted domains only; a source that a model proposed must have answered below status 400 when it was
    tried (``statuses``: ``url, status``, of all proposed sources)."""
    from pyspark.sql import Window

    own = retrieve.prepared(claims.select("claim_id", F.col("text").alias("claim_text"), "entities", "article_url"), "claim_text", "claim")
    rows = _mapped(layer, responses).where("url <> '' and text <> ''").join(own, "claim_id")
    first = Window.partitionBy("claim_id", "url").orderBy("pos")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    rows = rows.where(~urls.same_article(F.col("article_url"), F.col("url")))
    rows = rows.withColumn("trusted", F.lit(layer == "factcheck") | urls.domain(F.col("url")).isin(*(trusted or ("",))))
    if layer == "web_search":
        rows = rows.where("trusted")
    if layer == "ai_fallback":
        rows = rows.where(F.col("url").rlike(r"(?i)^https?://[^/?#]+"))
        if statuses is not None:
            rows = rows.join(statuses.where("status < 400").select("url").distinct(), "url", "left_semi")
    rows = retrieve.prepared(rows.withColumn("evidence_text", F.col("text")), "evidence_text", "evidence")
    if layer == "factcheck":
        rows = rows.withColumn("similarity", F.lit(FACT_CHECK_SIMILARITY))
    elif layer == "wikipedia":
        rows = rows.withColumn("similarity", lexical_overlap(F.col("claim_text"), F.col("text"), tx.WORD3))
    else:
        rows = rows.where(retrieve.relevant(rows, cfg, url="url", entities="entities"))
        rows = rows.withColumn("similarity", retrieve.candidate_similarity(F.col("claim_text"), F.col("text"), entities="entities"))
    best = Window.partitionBy("claim_id").orderBy("pos", "url")
    rows = rows.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= cfg.top_k)
    return rows.select(
        "claim_id", F.lit(layer).alias("layer"), "pos", "url", "title", "text", round_at(clamp(F.col("similarity"))).alias("similarity"), "source",
        "source_type", "trusted", "published_at", "metadata",
    )


def layer(name: str, responses: DataFrame, trusted: tuple[str, ...] = (), statuses: DataFrame | None = None):
    """The layer ``name`` over stored responses, as operators.retrieve.retrieve takes it."""
    return lambda claims, cfg: candidates(name, responses, claims, cfg, trusted=trusted, statuses=statuses)
