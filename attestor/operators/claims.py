"""Check-worthy claims: the detector of regular signals and the detector of weighted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..config import DEFAULT, EngineConfig
from ..functions import text as tx

#: The signals' patterns. Each is understood alike by Java and RE2; whole words are bounded by non-letters.
OPENING = {
    "greeting": "(?iu)^(" + tx.alternatives(lx.SOCIAL_OPENINGS) + r"|feliz([^\p{L}\p{N}_]|$))",
    "imperative": "(?iu)^" + tx.alternatives(lx.IMPERATIVE_OPENINGS) + "[- ]",
    "opinion": "(?iu)^" + tx.alternatives(lx.OPINION_OPENINGS) + tx.END,
}
SIGNALS = {
    # a percent sign counts only where a letter or digit follows it
    "numeric": "(?iu)" + tx.START + r"[0-9]+([.,][0-9]+)?\s*(" + tx.alternatives(lx.UNITS[1:]) + tx.END + r"|%[\p{L}\p{N}_])",
    "attribution": tx.whole(lx.ATTRIBUTION_VERBS),
    "causal": tx.whole(lx.CAUSAL),
    "comparative": "(?iu)" + tx.START + tx.alternatives(lx.COMPARATIVE) + r"[^\p{L}\p{N}_](.{0,28}[^\p{L}\p{N}_])?" + tx.alternatives(lx.COMPARED) + tx.END,
    "definition": tx.whole(lx.DEFINITION),
    "prediction": "(?iu)" + tx.START + tx.alternatives(lx.PREDICTION) + ".{0,40}[0-9]",
    "date": "(?iu)" + tx.START + r"([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{4}|" + "|".join(lx.MONTHS) + ")" + tx.END,
    "proper_noun": r"[.\s][A-ZÁÉÍÓÚÂÊÔÃÕÜ][a-záéíóúâêôãõü]+\s[A-ZÁÉÍÓÚÂÊÔÃÕÜ][a-záéíóúâêôãõü]+",
    "factual_verb": tx.whole(lx.FACTUAL_VERBS),
    "negation": tx.whole(lx.NEGATED_FACTS),
    "quantity": tx.START + "[0-9]+" + tx.END,
}
#: First signal of this list that is present names the claim's type.
TYPES = [
    ("attribution", "quoted"), ("causal", "causal"), ("comparative", "comparative"), ("numeric", "statistical"),
    ("prediction", "predictive"), ("definition", "definitional"),
]


#: Terms of which the first word must be in a sentence for the signal's pattern to match; others need a digit.
_TERMS = {
    "attribution": lx.ATTRIBUTION_VERBS, "causal": lx.CAUSAL, "comparative": lx.COMPARATIVE, "definition": lx.DEFINITION, "prediction": lx.PREDICTION,
    "factual_verb": lx.FACTUAL_VERBS, "negation": lx.NEGATED_FACTS, "date": lx.MONTHS,
}
_DIGIT = ("numeric", "quantity", "prediction")


def _held(text: Column, terms: dict[str, list[str]]) -> Column:
    """(words, digit): which of the terms' first words a sentence holds, and whether it holds a digit."""
    known = F.array(*[F.lit(w) for w in tx.first_words(t for own in terms.values() for t in own)])
    return F.struct(F.array_intersect(tx.words(F.lower(text), tx.LETTER + "+"), known).alias("words"), text.rlike("[0-9]").alias("digit"))


def _holds(column: str, terms: list[str]) -> Column:
    return F.arrays_overlap(f"{column}.words", F.array(*[F.lit(w) for w in tx.first_words(terms)]))


def with_signals(sentences: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``signals`` (those present, in the order of SIGNALS) and ``points``, their weights in hundredths. Each
    pattern is matched once, into a struct that both columns read, and only where the sentence holds a word or digit that
    it cannot do without. A quantity counts only without a numeric signal."""
    text = F.trim(F.col(text_col))
    rows = sentences.withColumn("__h", _held(text, _TERMS))

    def matched(name: str, pattern: str) -> Column:
        need = F.lit(True)
        if name in _TERMS:
            need = _holds("__h", _TERMS[name]) | (F.col("__h.digit") if name == "date" else F.lit(False))
        if name in _DIGIT:
            need = need & F.col("__h.digit")
        return F.when(need, text.rlike(pattern)).otherwise(F.lit(False))

    rows = rows.withColumn("__s", F.struct(*[matched(name, pattern).alias(name) for name, pattern in SIGNALS.items()]))
    found = {name: F.col(f"__s.{name}") for name in SIGNALS}
    found["quantity"] = found["quantity"] & ~found["numeric"]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))
    points = sum((F.when(c, F.lit(lx.SIGNAL_WEIGHTS[n])).otherwise(F.lit(0)) for n, c in found.items()), F.lit(0))
    return rows.withColumn("signals", names).withColumn("points", points).drop("__s", "__h")


def decide(sentences: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``decision`` (accept, ambiguous, reject), ``confidence``, ``reason`` and ``claim_type`` (null unless
    accepted) to rows of :func:`with_signals`. Rejects come first, in a fixed order; then the sum of weights decides:
    from 70 hundredths accept, from 30 ambiguous. Whole hundredths leave no rounding at the limits."""
    t = F.trim(F.col(text_col))
    early = [
        (F.length(t) < 25, "short", 9500), (F.endswith(t, F.lit("?")), "question", 9800), (t.rlike(OPENING["greeting"]), "greeting", 9700),
        (t.rlike(OPENING["imperative"]), "imperative", 9300), (t.rlike(OPENING["opinion"]), "opinion", 9000),
    ]
    points = F.col("points")
    reason, confidence = F.when(early[0][0], early[0][1]), F.when(early[0][0], F.lit(early[0][2]))
    for test, name, value in early[1:]:
        reason, confidence = reason.when(test, name), confidence.when(test, F.lit(value))
    reason = reason.when(points >= 70, "signals").when(points >= 30, "band").otherwise("weak")
    confidence = (
        confidence.when(points >= 70, F.least(F.lit(9300), 6500 + 18 * points))
        .when(points >= 30, F.lit(5000))
        .otherwise(F.greatest(F.lit(6000), 8500 - 100 * points))
    )
    decision = F.when(F.col("reason") == "signals", "accept").when(F.col("reason") == "band", "ambiguous").otherwise("reject")
    kind = F.coalesce(*[F.when(F.array_contains("signals", s), F.lit(k)) for s, k in TYPES], F.lit("factual"))
    out = sentences.withColumn("reason", reason).withColumn("confidence", (confidence / 10000.0).cast("double"))
    return out.withColumn("decision", decision).withColumn("claim_type", F.when(F.col("decision") == "accept", kind))


def resolve(decided: DataFrame, resolver=None) -> DataFrame:
    """Adds ``is_claim`` and ``method``. Ambiguous rows go to ``resolver``, a function from a DataFrame of them to
    the same with a boolean ``resolved``; without one, or where it gives null, they are no claims."""
    if resolver is None:
        decided = decided.withColumn("resolved", F.lit(None).cast("boolean"))
    else:
        sure = decided.where("decision <> 'ambiguous'").withColumn("resolved", F.lit(None).cast("boolean"))
        decided = sure.unionByName(resolver(decided.where("decision = 'ambiguous'")))
    ambiguous = F.col("decision") == "ambiguous"
    method = F.when(ambiguous & F.col("resolved").isNotNull(), "resolver").when(ambiguous, "ambiguous").otherwise("heuristic")
    claim = F.when(ambiguous, F.coalesce("resolved", F.lit(False))).otherwise(F.col("decision") == "accept")
    return decided.withColumn("method", method).withColumn("is_claim", claim).drop("resolved")


def batches(ambiguous: DataFrame, size: int = 8) -> DataFrame:
    """Numbers a document's ambiguous sentences into batches of ``size`` for a resolver."""
    order = Window.partitionBy("doc_id").orderBy("block_index", "sent_index")
    return ambiguous.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def claim_stats(decided: DataFrame, *by: str) -> DataFrame:
    """Sentences by decision, resolver calls of eight sentences and mean confidence (4 digits) for each group."""
    n = lambda d: F.count_if(F.col("decision") == d)
    confidence = F.sum(F.floor(F.col("confidence") * 10000 + 0.5).cast("long"))
    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sentences"),
        n("accept").alias("claims"),
        n("ambiguous").alias("ambiguous"),
        n("reject").alias("rejected"),
        F.ceil(n("ambiguous") / 8).cast("long").alias("calls"),
        (F.floor(confidence / F.count(F.lit(1)) + 0.5) / 10000).alias("mean_confidence"),
    )


# --- the detector of weighted evidence ------------------------------------------------------------------------------

QUESTION = r"(?iu)^\s*[\"«]?.{0,10}" + tx.alternatives(lx.QUESTION_WORDS) + r"[^.!?]{0,80}[?]\s*$"
CALL = r"(?iu)^\s*" + tx.alternatives(lx.CALL_STEMS) + "[a-z]*" + tx.END
OPINION = tx.whole(lx.OPINION_MARKERS)
CITATION = tx.whole(lx.CITATION_VERBS)
FACTUAL = (
    "(?iu)" + tx.START + r"([0-9]+[.,][0-9]+|R\$\s*[0-9]|US\$\s*[0-9]|segundo\s+[\p{L}\p{N}_]+|de\s+acordo\s+com|com\s+base\s+em|lei\s+n[°º]|"
    + "|".join(lx.FACTUAL_WORDS) + ")" + tx.END
)
ANY_NUMBER = r"(^|[^\p{L}\p{N}_])[0-9]+([.,][0-9]+)?(%|mil|milhão|milhões|bilhão|bilhões|metros?|km|kg|ton|anos?|meses?|dias?|horas?)?([^\p{L}\p{N}_]|$)"
#: Rule stand-ins for a parser's verb moods: endings of the commonest tenses.
INDICATIVE = r"(?iu)(^|[^\p{L}])(\p{L}{2,}(ou|eu|iu|aram|eram|iram|ará|erá|irá)|foi|é|são|está|estão|tem|têm|há)([^\p{L}]|$)"
MODAL = r"(?iu)(^|[^\p{L}])(pode|podem|poderia|poderiam|deve|devem|deveria|deveriam)([^\p{L}]|$)"
#: The same as tests of lower-cased text that need no back-tracking; the two above are what SQL is held against.
_INDICATIVE = r"\p{L}{2}(?:ou|eu|iu|[aei]ram|[aei]rá)(?!\p{L})|(?<!\p{L})(?:foi|é|são|está|estão|t[eê]m|há)(?!\p{L})"
_MODAL = r"(?<!\p{L})(?:pode|deve)(?:m|ria|riam)?(?!\p{L})"


#: Terms of which the first word must be in a sentence for the pattern to match, but for factual numbers.
_FACTS = {"opinion": lx.OPINION_MARKERS, "cited": lx.CITATION_VERBS, "factual": ["segundo", "de acordo com", "com base em", "lei", *lx.FACTUAL_WORDS]}


def rule_analysis(sentences: DataFrame, text_col: str = "text", parser=None) -> DataFrame:
    """Adds ``entities``, ``indicative``, ``modal`` and ``has_subject``, found by rules or by ``parser``, a function from a
    text column to a struct of them (see models.LanguageModel)."""
    t = F.col(text_col)
    if parser is not None:
        rows = sentences.withColumn("__a", parser(t))
        return rows.select("*", *[F.col(f"__a.{n}") for n in ("entities", "indicative", "modal", "has_subject")]).drop("__a")
    return (
        sentences.withColumn("entities", tx.entities(t))
        .withColumn("indicative", F.lower(t).rlike(_INDICATIVE))
        .withColumn("modal", F.lower(t).rlike(_MODAL))
        .withColumn("has_subject", t.rlike(r"^\s*\p{Lu}"))
    )


def checkability(sentences: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``label`` (checkable, opinion, rhetorical, noise), ``label_confidence`` and ``score`` to analysed rows.

    Quick rules come first. Otherwise the score adds tenths for entities (at most three), fifths for numbers, an
    indicative verb and factual words, smaller parts for citations and a subject, and takes off modality and opinion;
    from 25 hundredths, or from 10 with entities, a sentence is checkable."""
    t = F.trim(F.col(text_col))
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(F.lit(0))
    names = F.size("entities")
    # each pattern that several columns read is matched once
    sentences = sentences.withColumn("__h", _held(t, _FACTS))
    digit, holds = F.col("__h.digit"), lambda name: _holds("__h", _FACTS[name])
    tests = {
        "opinion": F.when(holds("opinion"), t.rlike(OPINION)), "factual": F.when(digit | holds("factual"), t.rlike(FACTUAL)),
        "cited": F.when(holds("cited"), t.rlike(CITATION)), "number": F.when(digit, t.rlike(ANY_NUMBER)),
        "question": F.when(F.contains(t, F.lit("?")), t.rlike(QUESTION)), "call": t.rlike(CALL),
    }
    sentences = sentences.withColumn("__m", F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()]))
    opinion, factual, cited, number, question, call = (F.col(f"__m.{n}") for n in tests)
    points = (
        F.least(F.lit(30), 10 * names) + flag(number, 20) + flag(F.col("indicative"), 20) + flag(factual, 20)
        + flag(cited, 15) + flag(F.col("has_subject"), 10) - flag(F.col("modal"), 15) - flag(opinion, 20)
    )
    out = sentences.withColumn("__p", F.greatest(F.lit(0), F.least(F.lit(100), points)))
    p = F.col("__p")
    rules = [
        (F.length(t) < 25, "noise", F.lit(100)), (F.endswith(t, F.lit("?")) | question, "rhetorical", F.lit(95)),
        (call, "noise", F.lit(95)), (opinion & ~factual, "opinion", F.lit(85)),
        ((p >= 25) | ((p >= 10) & (names > 0)), "checkable", p), (F.col("modal") & ~F.col("indicative"), "opinion", 100 - p),
    ]
    label, value = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, name, points_ in rules[1:]:
        label, value = label.when(test, name), value.when(test, points_)
    out = out.withColumn("label", label.otherwise("noise")).withColumn("label_confidence", value.otherwise(80) / 100.0)
    return out.withColumn("score", p / 100.0).drop("__p", "__m", "__h")


def detect(sentences: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Checkable sentences of enough confidence: the first ``max_claims`` of a document in its order, then ranked by
    confidence, ties in document order. Adds ``rank`` from 0, ``query`` and ``keywords``."""
    kept = sentences.where((F.col("label") == "checkable") & (F.col("label_confidence") >= cfg.claim_min_confidence))
    order = Window.partitionBy("doc_id").orderBy("block_index", "sent_index")
    kept = kept.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cfg.max_claims)
    best = Window.partitionBy("doc_id").orderBy(F.desc("label_confidence"), "block_index", "sent_index")
    kept = kept.withColumn("rank", F.row_number().over(best) - 1).drop("__n")
    return kept.withColumn("query", tx.query_text(F.col("text"), F.col("entities"))).withColumn("keywords", keywords(F.col("text")))


def detector_stats(sentences: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """What the detector saw of each document (rows of :func:`checkability`): sentences up to the one that fills
    ``max_claims``, claims, what was discarded and why, the share of claims and their mean confidence (3 digits), and how
    many have entities and numbers. A document whose sentences were all discarded has zeros."""
    order = Window.partitionBy("doc_id").orderBy("block_index", "sent_index").rowsBetween(Window.unboundedPreceding, -1)
    sure = (F.col("label") == "checkable") & (F.col("label_confidence") >= cfg.claim_min_confidence)
    rows = sentences.withColumn("__c", sure).withColumn("__n", F.coalesce(F.sum(F.col("__c").cast("int")).over(order), F.lit(0)))
    rows = rows.where(F.col("__n") < cfg.max_claims)
    n = lambda test: F.count_if(test)
    claims = n(F.col("__c"))
    points = F.sum(F.when(F.col("__c"), F.floor(F.col("label_confidence") * 10000 + 0.5)).otherwise(0).cast("long"))
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences_processed"),
        claims.alias("claims_found"),
        n(F.col("label") == "opinion").alias("discarded_opinion"),
        n(F.col("label") == "rhetorical").alias("discarded_rhetorical"),
        n((F.col("label") == "noise") | ((F.col("label") == "checkable") & ~F.col("__c"))).alias("discarded_noise"),
        (F.floor(claims / F.count(F.lit(1)) * 1000 + 0.5) / 1000).alias("checkability_rate"),
        F.when(claims > 0, F.floor(points / claims / 10 + 0.5) / 1000).otherwise(F.lit(0.0)).alias("avg_confidence"),
        n(F.col("__c") & (F.size("entities") > 0)).alias("claims_with_entities"),
        n(F.col("__c") & F.trim("text").rlike(ANY_NUMBER)).alias("claims_with_numbers"),
    )


def keywords(col: Column, n: int = 8) -> Column:
    """The first ``n`` distinct words of four letters or more that are no query stopwords."""
    found = tx.without(tx.words(F.lower(col), r"[\p{L}]{4,}"), lx.QUERY_STOPWORDS)
    return F.slice(found, 1, n)
