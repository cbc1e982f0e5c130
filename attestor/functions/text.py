"""Text columns: folding, tokens, sentences, normalisation. Patterns stay inside what Java and RE2 both understand."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lx

LETTER = r"[\p{L}\p{N}_]"
WORD3 = r"[\p{L}\p{N}_]{3,}"
WORD2 = r"[\p{L}\p{N}_]{2,}"
FEATURE_WORD = r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)?"
SPACE = r"[ \t\n\r\f\x0B]+"
#: Ends of whole words; RE2 has no look-around, so a neighbour is matched.
START, END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = accents()


def words(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def alternatives(terms: Iterable[str]) -> str:
    return "(" + "|".join(terms) + ")"


def whole(terms: Iterable[str]) -> str:
    """Pattern of any of the terms as whole words, whatever their case."""
    return "(?iu)" + START + alternatives(terms) + END


def first_words(terms: Iterable[str]) -> list[str]:
    """The first word of each term, in lower case: a text without any of them holds none of the terms as whole words."""
    return sorted({re.findall(r"\w+", t)[0].lower() for t in terms})


def bind(col: Column, f) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def strip_accents(col: Column) -> Column:
    return F.translate(col, ACCENTED, BARE)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE, " "))


def fold(col: Column) -> Column:
    """Lower case without accents, white space squeezed: for lexical matching."""
    return squeeze(strip_accents(F.lower(col)))


def plain(col: Column) -> Column:
    return F.lower(strip_accents(col))


def stance_fold(col: Column) -> Column:
    """Tags and two entities dropped, folded, other characters than letters, digits and ``%$.,`` as spaces."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), "<[^>]+>", " ")
    out = F.replace(F.replace(out, F.lit("&quot;"), F.lit(" ")), F.lit("&amp;"), F.lit(" "))
    return squeeze(F.regexp_replace(strip_accents(F.lower(out)), "[^a-z0-9%$., ]+", " "))


def without(tokens: Column, stopwords: Iterable[str]) -> Column:
    """Distinct tokens that are no stopwords, in order of first appearance."""
    return F.array_except(F.array_distinct(tokens), F.array(*[F.lit(w) for w in dict.fromkeys(stopwords)]))


def significant_tokens(col: Column) -> Column:
    return without(words(plain(F.coalesce(col, F.lit(""))), "[a-z0-9][a-z0-9-]{2,}"), lx.RETRIEVAL_STOPWORDS)


def phrase_tokens(col: Column) -> Column:
    return F.array_except(significant_tokens(col), F.array(*[F.lit(w) for w in lx.WEAK_TOKENS]))


def stance_tokens(folded: Column) -> Column:
    return without(words(folded, "[a-z0-9][a-z0-9-]{2,}"), lx.STANCE_STOPWORDS)


def feature_tokens(col: Column) -> Column:
    return words(fold(col), FEATURE_WORD)


def content_tokens(col: Column) -> Column:
    """Feature tokens of three characters or more that are neither stopwords nor digits."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(lx.FEATURE_STOPWORDS)])
    return F.filter(feature_tokens(col), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))


def sentences(col: Column) -> Column:
    """Pieces that end with ``.``, ``!`` or ``?`` and white space, trimmed, empty ones dropped."""
    marked = F.regexp_replace(col, "([.!?])" + SPACE, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def expand_abbreviations(col: Column) -> Column:
    """Whole-word abbreviations in any case, one after the other."""
    return reduce(lambda c, item: F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){item[0]}(?![\p{{L}}\p{{N}}_])", item[1]), lx.ABBREVIATIONS.items(), col)


def normalise_bert(col: Column) -> Column:
    return squeeze(expand_abbreviations(col))


def normalise_words(col: Column, *, min_length: int, stopwords: bool, lemma=None) -> Column:
    """Abbreviations expanded, folded, tokens that hold a letter and are long enough, optionally without stopwords and
    with a pluggable lemma column function."""
    tokens = words(strip_accents(F.lower(expand_abbreviations(col))), WORD2 if min_length <= 2 else WORD3)
    tokens = F.filter(tokens, lambda t: (F.length(t) >= min_length) & ~t.rlike(r"^[0-9_]+$"))
    if stopwords:
        stop = sorted({strip(w) for w in lx.JOURNAL_STOPWORDS + lx.LIGHT_STOPWORDS})
        tokens = F.filter(tokens, lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in stop]), t))
    return F.array_join(F.transform(tokens, lemma) if lemma else tokens, " ")


def strip(word: str) -> str:
    return word.translate(str.maketrans(ACCENTED, BARE))


def normalise_tfidf(col: Column, lemma=None) -> Column:
    return normalise_words(col, min_length=3, stopwords=True, lemma=lemma)


def normalise_similarity(col: Column) -> Column:
    return normalise_words(col, min_length=2, stopwords=False)


def query_text(col: Column, entities: Column | None = None) -> Column:
    """Search text of a claim: lower-cased words without query stopwords (words of entities are kept); where fewer
    than three are left, all words of three characters or more."""
    stop = F.array(*[F.lit(w) for w in lx.QUERY_STOPWORDS])
    own = F.array().cast("array<string>")
    if entities is not None:
        own = F.flatten(F.transform(entities, lambda e: F.split(F.lower(e), " ")))

    def chosen(tokens):
        kept = F.filter(tokens, lambda t: ~F.array_contains(stop, t) | F.array_contains(own, t))
        return bind(kept, lambda k: F.when(F.size(k) < 3, F.filter(tokens, lambda t: F.length(t) > 2)).otherwise(k))

    return F.array_join(bind(words(F.lower(col), WORD2), chosen), " ")


def _scaled(col: Column, unit: str, zeros: int) -> Column:
    """Numbers before ``unit`` written out: exact decimals instead of floating point, whole part kept."""
    pattern = rf"(\d+(?:[.,]\d+)?)\s*{unit}"
    number = F.regexp_extract(col, pattern, 1)
    value = (F.replace(number, F.lit(","), F.lit(".")).cast("decimal(20,9)") * F.lit(10**zeros)).cast("decimal(38,0)").cast("string")
    # one number of a unit at a time: texts hold few, and each turn settles the first that is left
    return F.when(number != "", F.regexp_replace(col, "(?s)^(.*?)" + pattern, F.concat(F.lit("$1"), value))).otherwise(col)


def _scaler(unit: str, zeros: int):
    return lambda t: _scaled(t, unit, zeros)


def rag_text(col: Column, turns: int = 3) -> Column:
    """Query text for retrieval: lower case, no leading demonstrative, scaled numbers written out (``turns`` of each
    unit), no currency sign, percent signs as a word, no empty adjectives, no light stopwords or single characters."""
    out = F.regexp_replace(F.lower(F.trim(col)), r"^(isso|este|esta|esse|essa|aquilo|aquele|aquela)\s+", "")
    for unit, zeros in (("bilhões?", 9), ("milhões?", 6), (r"mil(?![\p{L}\p{N}_])", 3)):
        for _ in range(turns):
            out = bind(out, _scaler(unit, zeros))
    out = F.regexp_replace(out, r"r\$\s*", "")
    out = F.regexp_replace(out, r"(\d+(?:[.,]\d+)?)\s*%", "$1 por cento")
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_]){alternatives(lx.EMPTY_ADJECTIVES)}(?![\p{{L}}\p{{N}}_])", "")
    stop = F.array(*[F.lit(w) for w in lx.LIGHT_STOPWORDS])
    return F.array_join(F.filter(F.split(out, SPACE), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)), " ")


def marker_hits(folded: Column, tokens: Column, terms: Iterable[str], held: Column | None = None) -> Column:
    """Occurrences of single-word terms as whole words and of longer ones as text. ``held`` may give the different tokens
    that are markers at all, so that only those that a text holds are counted."""
    terms = list(terms)
    single = F.array(*[F.lit(t) for t in terms if " " not in t]).cast("array<string>")
    own = F.array_intersect(tokens if held is None else held, single)
    hits = F.aggregate(own, F.lit(0), lambda n, t: n + F.size(F.filter(tokens, lambda x: x == t)))
    for term in (t for t in terms if " " in t):
        hits = hits + ((F.length(folded) - F.length(F.replace(folded, F.lit(term), F.lit("")))) / len(term)).cast("int")
    return hits


def phrases(col: Column, cap: int = 8) -> Column:
    """Quoted spans, capitalised runs with joining words, and codes; first of each spelling, at most ``cap``."""
    text = squeeze(col)
    quoted = F.regexp_extract_all(text, F.lit("[\"“”'‘’]([^\"“”'‘’]{3,80})[\"“”'‘’]"), F.lit(1))
    upper = "[A-ZÁÉÍÓÚÂÊÔÃÕÇ]"
    runs = words(text, rf"(?U)\b{upper}[\w.-]{{2,}}(?: (?:de|da|do|dos|das|e|&|{upper}[\w.-]+)){{0,6}}")
    codes = words(text, r"(?i)\b[A-Z]{2,}[- ]?\d{2,}[A-Z0-9/-]*\b")
    found = F.filter(F.concat(quoted, F.filter(runs, lambda p: F.length(p) >= 4), codes), lambda p: F.size(phrase_tokens(p)) > 0)
    return F.slice(distinct_by(found, plain), 1, cap)


def distinct_by(items: Column, key) -> Column:
    """Array items whose key no earlier item has."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def entities(col: Column) -> Column:
    """Runs of two or more capitalised words after a stop or white space, distinct in order."""
    word = "[A-ZÁÉÍÓÚÂÊÔÃÕÜ][a-záéíóúâêôãõü]+"
    return F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), col), F.lit(rf"[.\s]({word}(?:\s{word})+)"), F.lit(1)))


def subject(col: Column, names: Column) -> Column:
    """Topic of a sentence: its first domain keyword, else its first entity, else up to three of the first six words
    of the retrieval text that are longer than three characters, else ``geral``."""
    keyword = F.lower(F.regexp_extract(col, whole(lx.DOMAIN_KEYWORDS), 2))
    rest = F.array_join(F.slice(F.filter(F.slice(F.split(rag_text(col, turns=1), " "), 1, 6), lambda t: F.length(t) > 3), 1, 3), " ")
    return F.coalesce(F.nullif(keyword, F.lit("")), F.lower(F.get(names, F.lit(0))), F.nullif(rest, F.lit("")), F.lit("geral"))
