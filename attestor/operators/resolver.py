"""The resolver protocol: ambiguous sentences are asked about in numbered batches, and replies are joined back by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as tx
from ..functions import urls
from ..functions.numbers import round_at

#: Sentences in a batch and tries of a request.
BATCH, TRIES = 8, 3
CLAIM = "struct<text:string,normalized:string,confidence:double,claim_type:string,entities:array<string>,subject:string,explanation:string>"
REPLY = f"array<struct<index:int,is_claim:boolean,confidence:double,reject_reason:string,claims:array<{CLAIM}>>>"
#: The confidence of a sentence that nobody was asked about, whose request failed, whose reply is no list,
#: and of an answer that gives none.
UNASKED, FAILED, UNREADABLE, UNSAID = 0.5, 0.4, 0.35, 0.5
CLAIM_TYPES = ("statistical", "quoted", "causal", "comparative", "predictive", "definitional", "factual")


def requests(batched: DataFrame) -> DataFrame:
    """``doc_id, batch, n, message``: one request for each batch (see claims.batches), its sentences numbered from 1."""
    place = F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("block_index", "sent_index"))
    rows = batched.withColumn("index", place).groupBy("doc_id", "batch").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("index", "text"))).alias("l")
    )
    lines = F.array_join(F.transform("l", lambda x: F.concat(x["index"].cast("string"), F.lit(". "), x["text"])), "\n")
    return rows.select("doc_id", "batch", "n", F.concat(F.lit("Sentenças: "), F.col("n").cast("string"), F.lit("\n\n"), lines).alias("message"))


def first_reply(attempts: DataFrame, tries: int = TRIES) -> DataFrame:
    """``doc_id, batch, reply``: of the attempts at a request (``doc_id, batch, attempt`` from 1, ``reply`` null where it
    failed) the first of at most ``tries`` that came through; null where none did."""
    own = attempts.where(F.col("attempt") <= tries)
    return own.groupBy("doc_id", "batch").agg(F.min_by("reply", F.when(F.col("reply").isNotNull(), F.col("attempt"))).alias("reply"))


def answers(replies: DataFrame) -> DataFrame:
    """``doc_id, batch, readable, index, a``: the items of replies that are a JSON list, by their number, else by their
    place. Of items with one number the last counts."""
    bare = F.regexp_replace(F.regexp_replace("reply", "```(?:json)?", ""), r"^\s+|\s+$", "")
    rows = replies.select("doc_id", "batch", F.when(bare.startswith("["), F.from_json(bare, REPLY)).alias("items"))
    rows = rows.select("doc_id", "batch", F.posexplode("items").alias("pos", "a"))
    rows = rows.withColumn("index", F.coalesce("a.index", F.col("pos") + 1))
    return rows.groupBy("doc_id", "batch", "index").agg(F.max_by("a", "pos").alias("a"))


def resolved(batched: DataFrame, attempts: DataFrame) -> DataFrame:
    """``batched`` with ``is_claim, confidence, reject_reason, claims``. A sentence without an answer is no claim:
    nobody was asked (``unasked``), no try came through (``failed``), the reply is no list (``unreadable``), or its
    number is missing (null reason)."""
    place = F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("block_index", "sent_index"))
    rows = batched.withColumn("index", place)
    replies = first_reply(attempts)
    found = answers(replies)
    lists = found.select("doc_id", "batch").distinct().withColumn("__list", F.lit(True))
    asked = replies.select("doc_id", "batch", F.lit(True).alias("__asked"), (F.col("reply").isNotNull()).alias("__came"), F.col("reply").rlike(r"^\s*(```(json)?)?\s*\[\s*\]").alias("__none"))
    rows = rows.join(asked, ["doc_id", "batch"], "left").join(lists, ["doc_id", "batch"], "left").join(found, ["doc_id", "batch", "index"], "left")
    why = F.when(F.col("__asked").isNull(), "unasked").when(~F.col("__came"), "failed").when(F.col("__list").isNull() & ~F.col("__none"), "unreadable")
    value = (
        F.when(why == "unasked", UNASKED).when(why == "failed", FAILED).when(why == "unreadable", UNREADABLE).otherwise(F.coalesce("a.confidence", F.lit(UNSAID)))
    )
    none = F.array().cast(f"array<{CLAIM}>")
    return rows.select(
        *batched.columns, F.coalesce("a.is_claim", F.lit(False)).alias("is_claim"), value.alias("resolver_confidence"),
        F.coalesce(why, F.col("a.reject_reason")).alias("reject_reason"), F.coalesce("a.claims", none).alias("claims"),
    )


def claims_of(rows: DataFrame) -> DataFrame:
    """The claims of resolved sentences, one row each, with what the answer leaves out worked out from the sentence:
    ``doc_id, block_index, sent_index, claim_index, claim_text, normalized, confidence, claim_type, entities, subject``."""
    out = rows.select("doc_id", "block_index", "sent_index", "text", F.posexplode("claims").alias("claim_index", "c"))
    entities = F.coalesce("c.entities", F.array().cast("array<string>"))
    filled = lambda value, other: F.coalesce(F.nullif(F.col(value), F.lit("")), other)
    return out.select(
        "doc_id", "block_index", "sent_index", "claim_index", F.coalesce("c.text", "text").alias("claim_text"),
        filled("c.normalized", tx.rag_text(F.col("text"))).alias("normalized"), F.coalesce("c.confidence", F.lit(UNSAID)).alias("confidence"),
        F.when(F.col("c.claim_type").isin(*CLAIM_TYPES), F.col("c.claim_type")).otherwise("ambiguous").alias("claim_type"),
        entities.alias("entities"), filled("c.subject", tx.subject(F.col("text"), entities)).alias("subject"),
    )


def source_prompt(claims: DataFrame, trusted: tuple[str, ...], context: str = "context", url: str = "article_url") -> DataFrame:
    """``claim_id, prompt``: the request to a model with web search to name one source that speaks of a claim (``text``,
    ``queries``), or to say that it found none. Its reply is what sources.layers reads for ``ai_fallback``."""
    listed = F.to_json(F.col("queries"))
    parts = [
        F.lit("Encontre uma única fonte jornalística, oficial ou de checagem que trate diretamente da afirmação. Não julgue se ela é verdadeira."),
        F.concat(F.lit("Afirmação: "), F.col("text")),
        F.concat(F.lit("Contexto: "), F.coalesce(F.col(context), F.lit(""))),
        F.concat(F.lit("Notícia analisada, que não serve de fonte: "), F.coalesce(F.col(url), F.lit(""))),
        F.concat(F.lit("Consultas já feitas: "), listed),
        F.lit("Domínios preferidos: " + ", ".join(trusted)),
        F.lit('Responda só com JSON: {"found": true, "source": "", "title": "", "url": "", "text": "", "relation": "support|contradict|neutral", "confidence": 0.0}'),
        F.lit('Sem fonte verificável: {"found": false}'),
    ]
    return claims.select("claim_id", F.array_join(F.array(*parts), "\n").alias("prompt"))


def valid_source(url: Column, own: Column, status: Column) -> Column:
    """A proposed source counts: an http address, not the claim's own article, that answers below status 400."""
    return F.coalesce(url, F.lit("")).rlike(r"(?i)^https?://[^/?#]+") & ~urls.same_article(own, url) & (F.coalesce(status, F.lit(599)) < 400)


def result_rows(rows: DataFrame) -> DataFrame:
    """Decided sentences as JSON documents: the sentence, the decision with four digits and its claims."""
    four = lambda c: round_at(c)
    claims = F.transform("claims", lambda c: c.withField("confidence", four(F.coalesce(c["confidence"], F.lit(UNSAID)))))
    sentence = F.struct("text", "block_index", "sent_index")
    out = F.struct(sentence.alias("sentence"), "is_claim", four(F.col("resolver_confidence")).alias("confidence"), "reject_reason", claims.alias("claims"))
    return rows.select("doc_id", "block_index", "sent_index", F.to_json(out, {"ignoreNullFields": "false"}).alias("document"))
