"""The whole analysis of a table of pages or documents: from text to score and label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import urls
from ..operators import classify, claims, clean, features, pages, retrieve, score, segment, stance, vectors


def documents_of(page_rows: DataFrame) -> DataFrame:
    """``doc_id, url, title, text`` of pages: extracted, cleaned blocks as lines."""
    rows = pages.articles(page_rows)
    text = F.array_join(clean.clean_blocks(F.col("blocks")), "\n")
    return rows.select(F.col("page_id").alias("doc_id"), "url", "title", text.alias("text"))


def detect_claims(docs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``claim_id, doc_id, text, query, entities, article_url`` of the documents' checkable sentences."""
    rows = segment.sentences(segment.blocks(docs, keep=("url",)), cfg, keep=("url",))
    found = claims.detect(claims.checkability(claims.rule_analysis(rows)), cfg)
    ident = urls.claim_id(F.col("doc_id"), F.col("block_index"), F.col("sent_index"))
    return found.select(ident.alias("claim_id"), "doc_id", "text", "query", "entities", F.col("url").alias("article_url"))


def analyse(docs: DataFrame, layers: dict, cfg: EngineConfig = DEFAULT, model=None) -> dict[str, DataFrame]:
    """The relations of an analysis of ``docs`` (``doc_id, url, title, text``): claims, evidence, similarity, stance,
    features, reputation, scores. ``layers`` are those of operators.retrieve.retrieve; ``model`` a fitted classifier,
    optional. Nothing runs before a result is asked for."""
    found = detect_claims(docs, cfg)
    evidence = retrieve.retrieve(found, layers, cfg)
    left = vectors.embed(stance.prepared(found.select("claim_id", F.col("query").alias("claim_query"), F.col("text").alias("claim_text")), "claim_text", "claim"), "claim_query")
    right = vectors.embed(stance.prepared(evidence.drop("rank"), "text", "evidence"), "text", prefix=200)
    pairs = right.withColumnRenamed("embedding", "b").join(left.withColumnRenamed("embedding", "a"), "claim_id")
    pairs = pairs.withColumn("semantic", vectors.round_at(vectors.cosine(F.col("a"), F.col("b")))).drop("a", "b")
    ranked = vectors.rerank(pairs, cfg)
    top = stance.for_claims(found.select("claim_id"), ranked, cfg).withColumn("similarity", F.col("final"))
    judged = stance.pair_stance(top, cfg)
    told = stance.with_orphans(found, judged).join(found.select("claim_id", "doc_id"), "claim_id")
    best = ranked.where("rank = 0").select("claim_id", "layer", "source_type", "trusted")
    per_claim = vectors.claim_similarity(found, ranked).join(best, "claim_id", "left").join(found.select("claim_id", "doc_id"), "claim_id")
    reputed = score.reputation(docs, cfg=cfg).select("doc_id", "domain", "reputation", "reputation_level")
    rows = reputed.join(score.evidence_scores(per_claim.withColumn("valid", score.valid_evidence(cfg)), "doc_id"), "doc_id", "left")
    rows = rows.join(score.stance_rates(told, "doc_id"), "doc_id", "left")
    if model is None:
        rows = rows.withColumn("classifier", F.lit(None).cast("double"))
    else:
        probability = classify.classify(classify.chunk_rows(docs, cfg), model, cfg).select("doc_id", F.col("real_probability").alias("classifier"))
        rows = rows.join(probability, "doc_id", "left")
    numbers = ["claims", "valid_claims", "evidence_score", "coverage", "support", "contradict", "neutral", "insufficient", "support_rate", "contradiction_rate"]
    rows = score.final_score(rows.na.fill(0, numbers), cfg)
    text = features.with_risk(features.with_features(features.text_stats(docs, title_col="title"), title_col="title"), cfg)
    names = ["doc_id", "status", *features.STATS, "risk", "text_score", "risk_label", "flags"]
    return {
        "claims": found, "evidence": evidence, "similarity": ranked, "stance": told, "features": text.select(*names), "reputation": reputed, "scores": rows,
    }
