"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .training import held_out, labelled_sample
from .words import Adam, WordTable, bucket, clean, sigmoid

BUCKETS, FACTORS = 1 << 15, 8
#: Words in a window whose statistics are compared within a text.
WINDOW = 64
#: Labelled rows that a model learns from, for each class.
PER_CLASS = 1200
FOLDS, HELD = 3, 1
STATISTICS = (
    "log words", "log chars", "log lines", "words per line", "word length", "word length spread", "punctuation", "upper case",
    "digits", "bare punctuation", "variety", "variety least", "punctuation most", "upper case most", "digits most", "repeats",
    "repeats most", "word length most", "repeated lines", "short words",
)


def _word_facts(words: list[str]) -> tuple[np.ndarray, ...]:
    """Bucket, length, punctuation, upper-case letters and digits of each word."""
    return (
        np.array([bucket(clean(w).lower(), BUCKETS) for w in words], np.int64),
        np.array([len(w) for w in words], np.int64),
        np.array([sum(not c.isalnum() for c in w) for w in words], np.int64),
        np.array([sum(map(str.isupper, w)) for w in words], np.int64),
        np.array([sum(map(str.isdigit, w)) for w in words], np.int64),
    )


class Features:
    """Buckets of a text's different words and its statistics; what concerns one word is kept for the next texts."""

    def __init__(self):
        self.table = WordTable(_word_facts, (np.int64,) * 5)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.split()
        out = np.zeros(len(STATISTICS))
        if not words:
            return np.empty(0, np.int64), out
        at = self.table.numbers(words)
        place, length, punct, upper, digit = (a[at] for a in self.table.arrays)
        n, chars = len(words), max(1, int(length.sum()))
        pieces = max(1, n // WINDOW)
        starts = np.arange(pieces) * n // pieces
        sizes = np.diff(np.append(starts, n))
        own = np.repeat(np.arange(pieces), sizes)
        pairs = np.sort(own * (1 << 32) + at)
        different = np.bincount(own[np.concatenate(([True], np.diff(pairs) != 0))], minlength=pieces) / sizes
        again = np.concatenate(([False], at[1:] == at[:-1]))
        in_chars = np.maximum(np.add.reduceat(length, starts), 1)
        lines = [x for x in text.split("\n") if x.strip()]
        out[:] = (
            np.log1p(n),
            np.log1p(len(text)),
            np.log1p(len(lines)),
            np.log1p(n / max(1, len(lines))),
            chars / n,
            length.std(),
            punct.sum() / chars,
            upper.sum() / chars,
            digit.sum() / chars,
            (punct == length).mean(),
            different.mean(),
            different.min(),
            (np.add.reduceat(punct, starts) / in_chars).max(),
            (np.add.reduceat(upper, starts) / in_chars).max(),
            (np.add.reduceat(digit, starts) / in_chars).max(),
            again.mean(),
            (np.add.reduceat(again.astype(np.int64), starts) / sizes).max(),
            (in_chars / sizes).max(),
            1 - len(set(lines)) / max(1, len(lines)),
            (length < 3).mean(),
        )
        return np.unique(place), out


@dataclass
class Model:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    stat_weight: np.ndarray
    stat_factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logit(self, places: np.ndarray, stats: np.ndarray) -> float:
        """bias + linear terms + all pairwise interactions, by half the difference of squared sum and sum of squares."""
        x = 1 / np.sqrt(max(1, len(places)))
        s = np.clip((stats - self.mean) / self.scale, -4, 4)
        sums = self.factor[places].sum(0) * x + s @ self.stat_factor
        squares = (self.factor[places] ** 2).sum(0) * x * x + (s * s) @ self.stat_factor**2
        return float(self.bias + self.weight[places].sum() * x + s @ self.stat_weight + 0.5 * (sums**2 - squares).sum())


def train(rows: list[tuple[str, int]], turns: int = 150, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the logistic loss, with weight decay. Without rows of both classes only the bias is set: 0
    without any row."""
    size = len(STATISTICS)
    rng = np.random.default_rng(8)
    if len({y for _, y in rows}) < 2:
        bias = 0.0 if not rows else (10.0 if rows[0][1] else -10.0)
        return Model(bias, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)), np.zeros(size), np.zeros((size, FACTORS)), np.zeros(size), np.ones(size))
    features = Features()
    found = [features.of(t) for t, _ in rows]
    y = np.array([label for _, label in rows], np.float64)
    stats = np.array([s for _, s in found])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    s = np.clip((stats - mean) / scale, -4, 4)
    counts = np.array([len(p) for p, _ in found])
    used, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), counts)
    x = (1 / np.sqrt(np.maximum(counts, 1)))[doc]
    w, v = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), FACTORS))
    sw, sv, b = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), np.zeros(1)
    adam = Adam([w, v, sw, sv, b], rate, floor=1e-5)
    n = len(rows)
    for _ in range(turns):
        vx = v[at] * x[:, None]
        sums = np.stack([np.bincount(doc, vx[:, k], n) for k in range(FACTORS)], 1) + s @ sv
        squares = np.bincount(doc, (vx**2).sum(1), n) + (s * s) @ (sv**2).sum(1)
        out = b[0] + np.bincount(doc, w[at] * x, n) + s @ sw + 0.5 * ((sums**2).sum(1) - squares)
        err = (sigmoid(out) - y) / n
        e = err[doc] * x
        inner = e[:, None] * (sums[doc] - vx)
        adam.step(
            [
                np.bincount(at, e, len(used)) + decay * w,
                np.stack([np.bincount(at, inner[:, k], len(used)) for k in range(FACTORS)], 1) + decay * v,
                s.T @ err + decay * sw,
                s.T @ (err[:, None] * sums) - ((s * s).T @ err)[:, None] * sv + decay * sv,
                np.array([err.sum()]),
            ]
        )
    weight, factor = np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS))
    weight[used], factor[used] = w, v
    return Model(float(b[0]), weight, factor, sw, sv, mean, scale)


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, label: str = "quality", **cols) -> Model:
    return train(labelled_sample(docs, labels, label=label, folds=FOLDS, fold=HELD, per_class=per_class, **cols))


_SCORERS: dict = {}


def _scorer(shared):
    if shared.value is not _SCORERS.get("model"):
        _SCORERS.update(model=shared.value, features=Features())
    return shared.value, _SCORERS["features"]


def score_column(spark: SparkSession, model: Model, text) -> Column:
    """The score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def good(texts):
        import pandas as pd

        model, features = _scorer(shared)
        return pd.Series(sigmoid(np.array([model.logit(*features.of(t)) for t in texts], np.float64)), index=texts.index)

    return good(text.cast("string"))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1, higher: label 1 likelier), ``predicted`` and
    ``held_out``; columns of these names are replaced.

    The inputs are the whole text's different words, hashed, and the statistics of STATISTICS; null, empty and blank
    texts have no words and statistics of zero. Rows are scored one by one in time linear in their words, so repeated
    rows repeat their score, and an empty table gives no rows. No shuffle; the model of about 2 MB is broadcast.
    """
    value = score_column(docs.sparkSession, model, F.col(text_col))
    out = docs.withColumns({"held_out": held_out(F.col(id_col), FOLDS, HELD), "score": value})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
