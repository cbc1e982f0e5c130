"""Number columns: clamping, rounding, scores and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b <= 0, F.lit(0.0)).otherwise(a / b)


def round_at(col: Column, digits: int = 4) -> Column:
    """Half up, by the same arithmetic in any engine."""
    scale = float(10**digits)
    return F.floor(col * scale + 0.5) / scale


def number_tokens(col: Column) -> Column:
    return F.array_distinct(words(F.coalesce(col, F.lit("")), r"\d+(?:[.,]\d+)?%?"))


def digits_only(numbers: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(numbers, lambda n: F.regexp_replace(n, "[^0-9]", "")), lambda n: n != ""))


def stance_numbers(col: Column) -> Column:
    found = words(col, r"(?:r\$\s*)?\d+(?:[.,]\d+)?%?")
    return F.array_distinct(F.transform(found, lambda n: F.translate(F.regexp_replace(n, r"\s+", ""), ",", ".")))


def overlap_of(q: Column, t: Column) -> Column:
    """Over the distinct words of ``q``, the smaller of their counts in ``q`` and ``t``, per distinct word, at most 1."""
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))
    total = F.aggregate(F.array_intersect(q, t), F.lit(0), lambda acc, x: acc + F.least(count(q, x), count(t, x)))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), F.lit(0.0)).otherwise(
        round_at(F.least(total / F.size(F.array_distinct(q)), F.lit(1.0)))
    )


def lexical_overlap(query: Column, text: Column, word: str) -> Column:
    """:func:`overlap_of` two texts' words in lower case."""
    return overlap_of(words(F.lower(query), word), words(F.lower(text), word))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))
