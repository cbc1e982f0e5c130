"""From claims' evidence to a document's score and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import urls
from ..functions.numbers import clamp, round_at


def reputation(docs: DataFrame, url_col: str = "url", cfg: EngineConfig = DEFAULT, trusted: DataFrame | None = None) -> DataFrame:
    """Adds ``domain``, ``reputation`` (trusted .9, other .4, none 0) and ``reputation_level``. ``trusted`` may give the
    domains as a table of any size (``domain``), which is joined; the configured list is an expression."""
    out = docs.withColumn("domain", urls.domain(F.col(url_col)))
    if trusted is None:
        known = F.col("domain").isin(*cfg.trusted_domains)
    else:
        out = out.join(trusted.select("domain").distinct().withColumn("__t", F.lit(True)), "domain", "left")
        known = F.col("__t").isNotNull()
    level = F.when(F.col("domain") == "", "unknown").when(known, "trusted").otherwise("other")
    out = out.withColumn("reputation_level", level).drop("__t") if trusted is None else out.withColumn("reputation_level", level)
    value = F.when(F.col("reputation_level") == "trusted", 0.9).when(F.col("reputation_level") == "other", 0.4).otherwise(0.0)
    return out.withColumn("reputation", value).drop("__t")


def valid_evidence(cfg: EngineConfig = DEFAULT) -> Column:
    """A claim's best evidence counts: high and sufficient, no encyclopedia, and trusted if a model proposed it."""
    context = (F.coalesce("layer", F.lit("")) == "wikipedia") | (F.coalesce("source_type", F.lit("")) == "encyclopedia")
    proposed = (F.coalesce("layer", F.lit("")) == "ai_fallback") & ~F.coalesce("trusted", F.lit(False))
    return F.col("has_evidence") & (F.col("score") >= cfg.valid_score) & F.col("has_sufficient") & ~context & ~proposed


def evidence_scores(claims: DataFrame, *by: str) -> DataFrame:
    """Of claims with ``score`` and boolean ``valid``: the valid ones' mean score and their share of all claims."""
    points = F.sum(F.when(F.col("valid"), F.floor(F.col("score") * 10000 + 0.5)).otherwise(0).cast("long"))
    n = F.count_if(F.col("valid"))
    return claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("claims"),
        n.alias("valid_claims"),
        F.when(n > 0, F.floor(points / n + 0.5) / 10000).otherwise(F.lit(0.0)).alias("evidence_score"),
        round_at(n / F.count(F.lit(1))).alias("coverage"),
    )


def stance_rates(stances: DataFrame, *by: str) -> DataFrame:
    """Stances counted, and the shares of support and contradiction among those that are not insufficient."""
    n = lambda s: F.count_if(F.col("stance") == s)
    told = F.count_if(F.col("stance") != "insufficient")
    rate = lambda s: F.when(told > 0, round_at(n(s) / told)).otherwise(F.lit(0.0))
    kinds = ("support", "contradict", "neutral", "insufficient")
    return stances.groupBy(*by).agg(*[n(s).alias(s) for s in kinds], rate("support").alias("support_rate"), rate("contradict").alias("contradiction_rate"))


def final_score(rows: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds ``score`` (0 to 100) and ``label`` to rows with ``evidence_score, coverage, reputation, classifier``
    (null where there is none) ``, support_rate, contradiction_rate``. Without a classifier the other weights are
    scaled up to one."""
    evidence, reputation_, classifier = cfg.weights
    has = F.col("classifier").isNotNull()
    total = F.when(has, F.lit(evidence + reputation_ + classifier)).otherwise(F.lit(evidence + reputation_))
    weight = lambda w: round_at(F.lit(w) / total)
    value = (
        F.col("evidence_score") * F.col("coverage") * weight(evidence)
        + F.col("reputation") * weight(reputation_)
        + F.when(has, F.col("classifier") * weight(classifier)).otherwise(F.lit(0.0))
    )
    out = rows.withColumn("score", round_at(100 * clamp(value), 2))
    score, coverage = F.col("score"), F.col("coverage")
    label = (
        F.when(F.col("contradiction_rate") >= cfg.contradiction_rate, "unreliable")
        .when((coverage == 0) | (F.col("evidence_score") == 0), F.when(F.col("reputation") >= 0.80, "insufficient_evidence").otherwise("unverified"))
        .when(coverage < cfg.partial_coverage, "insufficient_evidence")
        .when((score >= 75) & (coverage >= cfg.reliable_coverage) & (F.col("support_rate") >= cfg.support_rate), "reliable")
        .when((score >= 50) | (F.col("evidence_score") >= cfg.valid_score), "partially_reliable")
        .otherwise("insufficient_evidence")
    )
    return out.withColumn("label", label)


def weighted_probability(chunks: DataFrame, *by: str, cfg: EngineConfig = DEFAULT, first: Column | None = None) -> DataFrame:
    """Chunk predictions (``label`` real or fake, ``score``, ``weight``) as one probability for each group, weighted by
    length; a class that no chunk has is the complement. Labels by the thresholds. Where a chunk has a row for each
    class, ``first`` is true in one of them, so that its weight counts once."""
    own = F.lit(True) if first is None else first
    points = lambda name: F.sum(
        F.when(F.col("label") == name, F.floor(F.col("score") * 10000 + 0.5) * F.greatest(F.lit(1), F.col("weight"))).otherwise(0).cast("long")
    )
    sums = chunks.groupBy(*by).agg(
        points("real").alias("__r"), points("fake").alias("__f"), F.sum(F.when(own, F.greatest(F.lit(1), F.col("weight"))).otherwise(0).cast("long")).alias("__w")
    )
    real, fake = F.col("__r") / F.col("__w") / 10000, F.col("__f") / F.col("__w") / 10000
    out = sums.withColumn("__p", F.when((F.col("__r") == 0) & (F.col("__f") > 0), 1 - fake).otherwise(real))
    out = out.withColumn("__q", F.when((F.col("__f") == 0) & (F.col("__r") > 0), 1 - real).otherwise(fake))
    p, q = clamp(F.col("__p")), clamp(F.col("__q"))
    label = F.when((p >= cfg.true_threshold) & (p >= q), "reliable").when((q >= cfg.fake_threshold) & (q > p), "unreliable").otherwise("undefined")
    return out.select(
        *by, round_at(p).alias("real_probability"), round_at(q).alias("fake_probability"), round_at(F.greatest(p, q)).alias("confidence"), label.alias("label")
    )
