"""Stance of evidence towards claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..config import DEFAULT, EngineConfig
from ..functions import text as tx
from ..functions.numbers import clamp, round_at, stance_numbers


def prepared(df: DataFrame, text: str, prefix: str, negation=lx.NEGATION, contradiction=lx.CONTRADICTION, phrases=lx.CONTRADICTION_PHRASES) -> DataFrame:
    """Adds what the stance of a pair needs of one text: folded form, tokens, numbers, negation and contradiction marks."""
    folded = tx.stance_fold(F.col(text))
    out = df.withColumn(f"{prefix}_folded", folded).withColumn(f"{prefix}_words", tx.words(F.col(f"{prefix}_folded"), "[a-z0-9]+"))
    marks = lambda terms: F.arrays_overlap(F.col(f"{prefix}_words"), F.array(*[F.lit(t) for t in terms]))
    spoken = F.col(f"{prefix}_folded").rlike(tx.alternatives(phrases))
    return (
        out.withColumn(f"{prefix}_terms", tx.stance_tokens(F.col(f"{prefix}_folded")))
        .withColumn(f"{prefix}_figures", stance_numbers(F.col(f"{prefix}_folded")))
        .withColumn(f"{prefix}_negated", marks(negation))
        .withColumn(f"{prefix}_contradicts", marks(contradiction) | spoken)
    )


def overlap() -> Column:
    both = (F.size("claim_terms") > 0) & (F.size("evidence_terms") > 0)
    return F.when(both, round_at(F.size(F.array_intersect("claim_terms", "evidence_terms")) / F.size("claim_terms"))).otherwise(F.lit(0.0))


def numbers_conflict(share: Column) -> Column:
    """Figures of one kind on both sides, none in common, in texts with much in common."""
    kind = lambda side, mark: F.exists(f"{side}_figures", lambda n: F.contains(n, F.lit(mark)))
    known = (F.size("claim_figures") > 0) & (F.size("evidence_figures") > 0) & ~F.arrays_overlap("claim_figures", "evidence_figures")
    same = (kind("claim", "%") & kind("evidence", "%")) | (kind("claim", "r$") & kind("evidence", "r$"))
    return (share >= 0.60) & known & same


def pair_stance(pairs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds ``overlap``, ``stance``, ``confidence`` and ``reason`` to prepared pairs with ``similarity``, ``layer`` and
    ``source_type``; the first rule that holds decides."""
    out = pairs.withColumn("overlap", overlap())
    sim, share = F.col("similarity"), F.col("overlap")
    context = (F.col("layer") == "wikipedia") | (F.col("source_type") == "encyclopedia")
    empty = (F.col("claim_folded") == "") | (F.col("evidence_folded") == "")
    support = round_at(clamp(0.55 + sim * 0.25 + share * 0.20, 0.60, 0.88))
    rules = [
        (empty, "insufficient", F.lit(1.0), "empty"),
        (sim < cfg.stance_min_similarity, "insufficient", F.lit(0.85), "similarity"),
        (context, "neutral", F.lit(0.60), "context"),
        (numbers_conflict(share), "contradict", F.lit(0.78), "numbers"),
        (F.col("evidence_contradicts") & (share >= cfg.neutral_overlap), "contradict", F.lit(0.70), "marker"),
        ((F.col("claim_negated") != F.col("evidence_negated")) & (share >= cfg.support_overlap), "contradict", F.lit(0.64), "polarity"),
        (share >= cfg.support_overlap, "support", support, "overlap"),
        ((sim >= cfg.high_similarity) & (share >= cfg.neutral_overlap), "support", F.lit(0.66), "similar"),
        (share >= cfg.neutral_overlap, "neutral", F.lit(0.58), "topic"),
    ]
    first = lambda k: F.coalesce(*[F.when(r[0], F.lit(r[k]) if isinstance(r[k], str) else r[k]) for r in rules])
    return (
        out.withColumn("stance", F.coalesce(first(1), F.lit("insufficient")))
        .withColumn("confidence", F.coalesce(first(2), F.lit(0.75)))
        .withColumn("reason", F.coalesce(first(3), F.lit("weak")))
    )


def for_claims(claims: DataFrame, reranked: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pairs to judge: each claim's first ``stance_top_k`` sufficient pieces of evidence by rank."""
    best = Window.partitionBy("claim_id").orderBy("rank")
    top = reranked.where("is_sufficient").withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= cfg.stance_top_k)
    return claims.join(top.drop("__n"), "claim_id")


def for_raw_evidence(claims: DataFrame, evidence: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pairs to judge where nothing was reranked: each claim's ``stance_top_k`` pieces of evidence by similarity, ties by
    id. Their own similarity counts."""
    best = Window.partitionBy("claim_id").orderBy(F.desc(F.coalesce("similarity", F.lit(0.0))), "evidence_id")
    top = evidence.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= cfg.stance_top_k)
    return claims.join(top.drop("__n"), "claim_id")


def similarity_of(pairs: DataFrame, override: Column | None = None) -> Column:
    """The similarity that a pair is judged by: an override, else the final one, the retrieval's, the semantic one."""
    held = [F.col(c) for c in ("final", "similarity", "semantic") if c in pairs.columns]
    return clamp(F.coalesce(*([override] if override is not None else []), *held, F.lit(0.0)))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed; else empty."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def with_orphans(claims: DataFrame, judged: DataFrame, confidence: float = 0.9) -> DataFrame:
    """``claim_id, evidence_id, stance, confidence, reason``; a claim without judged evidence has one insufficient row of
    ``confidence`` (1 where the evidence was not reranked)."""
    rows = claims.select("claim_id").join(judged.select("claim_id", "evidence_id", "stance", "confidence", "reason"), "claim_id", "left")
    return rows.select(
        "claim_id",
        F.coalesce("evidence_id", F.lit("")).alias("evidence_id"),
        F.coalesce("stance", F.lit("insufficient")).alias("stance"),
        F.coalesce("confidence", F.lit(confidence)).alias("confidence"),
        F.coalesce("reason", F.lit("none")).alias("reason"),
    )


def attach(evidence: DataFrame, judged: DataFrame) -> DataFrame:
    """Evidence with its stance, matched by claim, canonical address and text fingerprint; unmatched rows keep null."""
    from ..functions import urls

    key = lambda df: df.withColumn("__u", urls.canonical(F.col("url"))).withColumn("__f", urls.fingerprint(F.col("text")))
    best = key(judged).groupBy("claim_id", "__u", "__f").agg(
        F.max_by("stance", "rank").alias("stance"), F.max_by("confidence", "rank").alias("stance_confidence")
    )
    return key(evidence).join(best, ["claim_id", "__u", "__f"], "left").drop("__u", "__f")
