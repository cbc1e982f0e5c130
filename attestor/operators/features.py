"""Linguistic features, their risk score, label and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..config import DEFAULT, EngineConfig
from ..functions import text as tx
from ..functions.numbers import clamp, round_at, safe_div

NUMBER = r"(?iu)[0-9]+(?:[.,][0-9]+)?"
DATE = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}|" + "|".join(tx.strip(m) for m in lx.MONTHS)
QUOTE = "[\"“”‘’']"
MARKERS = {
    "sensationalism": lx.SENSATIONALISM, "emotional": lx.EMOTIONAL, "clickbait": lx.CLICKBAIT, "subjective": lx.SUBJECTIVE,
    "absolute": lx.ABSOLUTE, "weak_attribution": lx.WEAK_ATTRIBUTION, "source_attribution": lx.SOURCE_ATTRIBUTION, "data": lx.DATA_TERMS,
}
FLAGS = (
    "sensational_language", "emotional_vocabulary", "clickbait_tone", "emphatic_punctuation", "upper_case", "weak_attribution",
    "verifiable_content", "short_text", "no_strong_signal",
)


def _count(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def text_stats(docs: DataFrame, text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """Adds the measures of an article's text, all from one row and without a shuffle. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__text", text).withColumn("__folded", tx.fold(F.col("__text")))
    out = out.withColumn("__words", tx.words(F.col("__folded"), tx.FEATURE_WORD)).withColumn("__content", tx.content_tokens(F.col("__text")))
    out = out.withColumn("__sentences", F.filter(tx.sentences(F.col("__text")), lambda s: F.length(s) >= 3))
    # accents and white space do not change how many words there are
    lengths = F.filter(F.transform("__sentences", lambda s: F.regexp_count(F.lower(s), F.lit(tx.FEATURE_WORD))), lambda n: n > 0)
    out = out.withColumn("__lengths", lengths)
    t, words = F.col("__text"), F.size("__words")
    total = F.aggregate("__lengths", F.lit(0), lambda a, x: a + x)
    title = F.size(tx.feature_tokens(F.col(title_col))) if title_col else F.lit(0)
    return (
        out.withColumn("char_count", F.length(t))
        .withColumn("word_count", words)
        .withColumn("content_word_count", F.size("__content"))
        .withColumn("unique_content_words", F.size(F.array_distinct("__content")))
        .withColumn("lexical_diversity", round_at(safe_div(F.col("unique_content_words"), F.col("content_word_count"))))
        .withColumn("sentence_count", F.size("__sentences"))
        .withColumn("avg_sentence_words", round_at(safe_div(total, F.size("__lengths")), 2))
        .withColumn("max_sentence_words", F.coalesce(F.array_max("__lengths"), F.lit(0)))
        .withColumn("title_word_count", title)
        .withColumn("uppercase_ratio", round_at(safe_div(_count(t, r"\p{Lu}"), F.length(F.regexp_replace(t, r"\P{L}+", "")))))
        .withColumn("punctuation_density", round_at(_count(t, "[.,;:!?…]") / F.greatest(words, F.lit(1))))
        .withColumn("exclamation_count", F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))))
        .withColumn("question_count", F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit(""))))
        .withColumn("numbers_count", _count(t, NUMBER))
        .withColumn("dates_count", _count(F.col("__folded"), DATE))
        .withColumn("quote_marks_count", _count(t, QUOTE))
        .withColumn("url_count", _count(t, r"(?i)https?://|www\."))
    )


STATS = [
    "char_count", "word_count", "content_word_count", "unique_content_words", "lexical_diversity", "sentence_count",
    "avg_sentence_words", "max_sentence_words", "title_word_count", "uppercase_ratio", "punctuation_density", "exclamation_count",
    "question_count", "numbers_count", "dates_count", "quote_marks_count", "url_count",
]


def _scaled(hits: Column, tokens: Column, scale: int) -> Column:
    return F.when(hits > 0, clamp(F.log1p(hits / tokens * scale * 100) / F.log1p(F.lit(float(scale))))).otherwise(F.lit(0.0))


def with_features(stats: DataFrame, title_col: str | None = None, markers: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds marker counts ``n_*`` and the nine features to rows of :func:`text_stats`. A title's sensational and
    clickbait terms weigh more. ``markers`` may replace word lists by name."""
    use = MARKERS | (markers or {})
    folded, words = F.col("__folded"), F.col("__words")
    if title_col:
        title = tx.fold(F.coalesce(F.col(title_col), F.lit("")))
        folded, words = F.concat_ws(" ", title, folded), F.concat(tx.words(title, tx.FEATURE_WORD), words)
    # which markers a text holds at all is found once for all lists
    every = sorted({t for terms in use.values() for t in terms if " " not in t})
    stats = stats.withColumn("__held", F.array_intersect(words, F.array(*[F.lit(t) for t in every])))
    counts = [tx.marker_hits(folded, words, terms, F.col("__held")).alias(f"n_{name}") for name, terms in use.items()]
    out = stats.select("*", *counts).drop("__held")
    in_title = F.lit(0)
    if title_col:
        title_words = tx.words(title, tx.FEATURE_WORD)
        in_title = tx.marker_hits(title, title_words, use["sensationalism"] + use["clickbait"])
    n = {name: F.col(f"n_{name}") for name in use}
    tokens = F.greatest(F.col("content_word_count"), F.lit(1))
    count = F.greatest(F.col("word_count"), F.lit(1))
    bonus = clamp(n["source_attribution"] / F.greatest(F.col("word_count") / 120, F.lit(1.0)))
    facts = F.col("numbers_count") + F.col("dates_count") + n["source_attribution"] + n["data"] + F.col("quote_marks_count") * 0.25
    average, longest = F.col("avg_sentence_words"), F.col("max_sentence_words")
    fit = F.when(average <= 0, F.lit(0.0)).when(average < 12, average / 12).when(average <= 32, F.lit(1.0)).otherwise(clamp(1 - (average - 32) / 38))
    features = {
        "sensationalism": _scaled(n["sensationalism"] + 1.5 * in_title, tokens, 35),
        "emotional_language": _scaled(n["emotional"], tokens, 30),
        "clickbait": _scaled(n["clickbait"] + in_title, tokens, 25),
        "punctuation_excess": clamp(
            F.col("exclamation_count") / count * 28 + F.col("question_count") / count * 16
            + F.greatest(F.lit(0.0), F.col("punctuation_density") - 0.16) * 2.5
        ),
        "uppercase_excess": clamp((F.col("uppercase_ratio") - 0.12) / 0.18),
        "subjectivity": _scaled(n["subjective"] + 0.7 * n["absolute"], tokens, 35),
        "weak_attribution": clamp(clamp(n["weak_attribution"] / 3) * (1 - 0.45 * bonus)),
        "factual_density": clamp(facts / count * 22),
        "readability": clamp(fit * (1 - 0.35 * clamp((longest - 65) / 55))),
    }
    return out.select("*", *[round_at(v).alias(k) for k, v in features.items()])


def with_risk(features: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds ``status`` (``empty`` under the least length), ``risk``, ``text_score``, ``risk_label`` and ``flags``."""
    weighted = sum((F.col(k) * w for k, w in lx.RISK_WEIGHTS.items()), F.lit(0.0)) / sum(lx.RISK_WEIGHTS.values())
    risk = round_at(clamp(weighted * (1 - 0.18 * F.col("factual_density") - 0.07 * F.col("readability"))))
    out = features.withColumn("status", F.when(F.col("char_count") < cfg.features_min_chars, "empty").otherwise("ok"))
    out = out.withColumn("risk", risk).withColumn("text_score", round_at(1 - F.col("risk")))
    label = F.when(F.col("risk") >= cfg.high_risk, "high").when(F.col("risk") >= cfg.medium_risk, "attention").otherwise("low")
    tests = [F.col(k) >= cfg.medium_risk for k in ("sensationalism", "emotional_language", "clickbait", "punctuation_excess", "uppercase_excess", "weak_attribution")]
    tests += [F.col("factual_density") >= 0.35, F.col("word_count") < 180]
    flags = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, FLAGS)]))
    calm = (F.size(flags) == 0) & (F.col("risk") < cfg.medium_risk)
    return out.withColumn("risk_label", label).withColumn("flags", F.when(calm, F.array(F.lit(FLAGS[-1]))).otherwise(flags))


def top_terms(docs: DataFrame, *by: str, n: int = 12, text_col: str = "text") -> DataFrame:
    """The ``n`` commonest content words of each group, ties by word: ``by, term, count, rank``."""
    from pyspark.sql import Window

    terms = docs.select(*by, F.explode(tx.feature_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy(*by, "term").count()
    # each different word is looked at once
    terms = terms.where((F.length("term") >= 3) & ~F.col("term").isin(*dict.fromkeys(lx.FEATURE_STOPWORDS)) & ~F.col("term").rlike("^[0-9]+$"))
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "term")
    return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
