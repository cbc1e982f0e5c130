"""Sinks: nested documents and flat projections of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_at

SNIPPET = 200


def nested_documents(articles: DataFrame, claims: DataFrame, evidence: DataFrame, scores: DataFrame) -> DataFrame:
    """``doc_id, document``: one JSON document for each article with its claims, their evidence by rank (texts cut to
    SNIPPET characters) and its score. Lists are gathered for one document at a time."""
    item = F.struct("rank", "evidence_id", "url", "source", "layer", "similarity", "stance", F.substring("text", 1, SNIPPET).alias("text"))
    per_claim = evidence.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    rows = claims.join(per_claim, "claim_id", "left")
    entry = F.struct("claim_id", "text", F.coalesce("evidence", F.array()).alias("evidence"))
    per_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", entry.alias("c")))).alias("l"))
    out = articles.join(per_doc.select("doc_id", F.col("l.c").alias("claims")), "doc_id", "left").join(scores, "doc_id", "left")
    names = [c for c in out.columns]
    return out.select("doc_id", F.to_json(F.struct(*names)).alias("document"))


def write_json(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("overwrite").text(path)


def evidence_payload(evidence: DataFrame) -> DataFrame:
    """Evidence as rows for a database: renamed columns, scores to four digits."""
    return evidence.select(
        F.col("evidence_id").alias("id"), "claim_id", F.col("text").alias("content"), F.col("source").alias("source_name"), F.col("url").alias("source_url"),
        "source_type", F.col("layer").alias("retrieval_layer"), (F.floor(F.col("similarity") * 10000 + 0.5) / 10000).alias("similarity_score"),
        F.col("trusted").alias("is_trusted"), "published_at",
    )


def retrieval_payload(evidence: DataFrame) -> DataFrame:
    """Each claim's best similarity, layers and evidence as one row."""
    item = F.struct("rank", "evidence_id", "url", "similarity")
    return evidence.groupBy("claim_id").agg(
        F.max("similarity").alias("rag_score"),
        F.count(F.lit(1)).alias("n_evidence"),
        F.array_sort(F.collect_set("layer")).alias("layers_used"),
        F.array_sort(F.collect_list(item)).alias("evidence"),
    )


def _document(*fields) -> F.Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def stance_documents(judged: DataFrame) -> DataFrame:
    """``claim_id, evidence_id, document``: one JSON document for each judged pair, numbers to four digits."""
    four = lambda c: round_at(F.col(c)).alias(c)
    return judged.select(
        "claim_id", "evidence_id",
        _document("claim_id", "evidence_id", "stance", four("confidence"), "reason", four("similarity"), four("overlap"), "source", "url", "layer", "source_type", "trusted").alias("document"),
    )


def similarity_documents(claims: DataFrame, reranked: DataFrame) -> DataFrame:
    """``claim_id, document``: each claim with its evidence by rank, as one JSON document; a claim without any has an
    empty list and scores of zero."""
    item = F.struct("rank", "evidence_id", "similarity", "semantic", "final", "is_sufficient")
    lists = reranked.groupBy("claim_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"), F.max("final").alias("score"), F.bool_or("is_sufficient").alias("sufficient"))
    rows = claims.select("claim_id").join(lists, "claim_id", "left")
    score, sufficient = F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("sufficient", F.lit(False)).alias("has_sufficient")
    return rows.select("claim_id", _document("claim_id", score, sufficient, F.coalesce("evidence", F.array()).alias("evidence")).alias("document"))
