"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .training import held_out, labelled_sample
from .words import Adam, WordTable, chunks_of, clean, sigmoid

BUCKETS, DIMS = 1 << 17, 4
GRAMS = (3, 4, 5)
#: A bag averages the different words among so many; a text's score is that of its most toxic bag.
WINDOW = 6
#: Neutral subwords added to each bag, so that one odd word alone does not decide.
PRIOR = 120
#: Labelled rows that a model learns from, for each class.
PER_CLASS = 800
FOLDS, HELD = 5, 0


@dataclass
class Model:
    """``weight``: per bucket, the difference of the two classes' logits, which is linear in the embedding, so the
    softmax of an averaged bag needs one number for each subword."""

    weight: np.ndarray
    bias: float


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of 64 bits as buckets."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 17)).astype(np.int64) & (BUCKETS - 1)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of the words' subwords, by array operations over all words at once: the word with its ends
    marked, and its character n-grams. A word of punctuation only has none."""
    marked = [f"<{w}>" for w in map(clean, words)]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), size)
    real = size > 2
    base = np.uint64(0x100000001B3)
    # the whole word: a sum over its characters, each weighted by a power of its place
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, base, np.uint64))
    whole = np.add.reduceat(codes * power[place], np.cumsum(size) - size) if len(codes) else codes
    owners, buckets = [np.flatnonzero(real)], [_mixed(whole + np.uint64(99))[real]]
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * base + codes[k : len(codes) - n + 1 + k]
        own = owner[: len(h)]
        held = (own == owner[n - 1 :]) & (size[own] > n) & real[own]
        owners.append(own[held])
        buckets.append(_mixed(h[held]))
    return np.concatenate(owners), np.concatenate(buckets)


def _windows(n: int) -> np.ndarray:
    """Starts of the bags of n words: even pieces of at most WINDOW words."""
    pieces = max(1, -(-n // WINDOW))
    return np.arange(pieces) * n // pieces


def train(rows: list[tuple[str, int]], turns: int = 60, rate: float = 0.3) -> Model:
    """Learns embeddings and softmax weights together, first from bags of whole texts, then from each text's most
    toxic bag, so that a toxic text is learnt where it is toxic and clean ones where they come nearest to it."""
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 20.0 if rows and rows[0][1] else -20.0)
    number: dict[str, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in chunks_of(t)] for t, _ in rows]
    keep = [i for i, t in enumerate(texts) if t]
    y = np.array([rows[i][1] for i in keep], np.float64)
    texts = [np.array(texts[i]) for i in keep]
    owner, flat = subwords(list(number))
    owner = owner.astype(np.int32)
    count = np.bincount(owner, minlength=len(number)).astype(np.float64)
    used, flat = np.unique(flat, return_inverse=True)  # only buckets in use are trained, the others weigh 0
    flat = flat.astype(np.int32)
    word = np.concatenate(texts)
    pieces = [_windows(len(t)) for t in texts]
    sizes = np.array([len(p) for p in pieces])
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    starts = np.concatenate([p + b for p, b in zip(pieces, base)])
    window = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
    window, word = np.unique(np.stack([window, word]), axis=1)
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))

    rng = np.random.default_rng(5)
    embed = rng.normal(0, 0.001, (len(used), DIMS)).astype(np.float32)
    soft = rng.normal(0, 1.0, (DIMS, 2)).astype(np.float32)
    shift = np.zeros(2, np.float32)
    adam = Adam([embed, soft, shift], rate, floor=2e-5)

    def spread(by, values, n, at=slice(None)):
        """Sums of the rows ``values[at]`` for each of the n values of ``by``, one dimension at a time."""
        return np.stack([np.bincount(by, np.ascontiguousarray(values[:, k])[at], n) for k in range(values.shape[1])], 1)

    total_w = np.bincount(window, count[word], len(starts)) + PRIOR
    total_d = np.bincount(doc, total_w, len(texts))
    for turn in range(turns):
        by_word = spread(owner, embed, len(number), flat).astype(np.float32)
        sums = spread(window, by_word, len(starts), word)
        if turn < turns // 3:
            bags, of, total = spread(doc, sums, len(texts)), None, total_d
        else:
            logit = (sums / total_w[:, None]) @ (soft[:, 1] - soft[:, 0])
            order = np.lexsort((-logit, doc))
            of = order[first]
            bags, total = sums[of], total_w[of]
        bags = bags / total[:, None]
        p = sigmoid(bags @ (soft[:, 1] - soft[:, 0]) + shift[1] - shift[0])
        err = (p - y) / len(y)
        err = np.stack([-err, err], 1)
        back = (err @ soft.T) / total[:, None]
        if of is None:
            per_window = back[doc]
        else:
            per_window = np.zeros((len(starts), DIMS))
            per_window[of] = back
        per_word = spread(word, per_window, len(number), window)
        grad = spread(flat, per_word, len(used), owner) + 1e-7 * embed
        adam.step([grad.astype(np.float32), (bags.T @ err).astype(np.float32), err.sum(0).astype(np.float32)])
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = embed @ (soft[:, 1] - soft[:, 0])
    return Model(weight, float(shift[1] - shift[0]))


class Scorer:
    """Scores whole texts; the sums of a word's subwords are kept for the words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.table = WordTable(self._work_out, (np.float64, np.int64))

    def _work_out(self, words):
        owner, grams = subwords(words)
        return np.bincount(owner, self.model.weight[grams], len(words)), np.bincount(owner, minlength=len(words))

    def logit(self, text: str | None) -> float:
        words = chunks_of(text)
        best = 0.0
        if words:
            at = self.table.numbers(words)
            starts = _windows(len(words))
            # a word that is repeated in a bag counts once
            mark = np.zeros(len(words), np.int64)
            mark[starts[1:]] = 1 << 32
            at = np.sort(at + np.cumsum(mark))
            once = np.concatenate(([True], at[1:] != at[:-1]))
            at, bag = at & 0xFFFFFFFF, at >> 32
            total = np.bincount(bag, self.table.arrays[0][at] * once)
            best = float((total / (np.bincount(bag, self.table.arrays[1][at] * once) + PRIOR)).max())
        return best + self.model.bias


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, label: str = "toxic", **cols) -> Model:
    return train(labelled_sample(docs, labels, label=label, folds=FOLDS, fold=HELD, per_class=per_class, **cols))


def score_column(spark: SparkSession, model: Model, text) -> Column:
    """The score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        scorer = _scorer(shared)
        return pd.Series(sigmoid(np.array([scorer.logit(t) for t in texts], np.float64)), index=texts.index)

    return toxic(text.cast("string"))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1), ``predicted`` and ``held_out``; columns of these
    names are replaced.

    Each whole text is cut into bags of at most WINDOW words; a bag's score is the softmax of its averaged subword
    embeddings and a text's score that of its worst bag. Null, empty and blank texts are scored by the bias alone. A
    null id is not held out of anything it could be learnt from, but unlabelled. Rows are scored one by one, so
    repeated rows repeat their score, and an empty table gives no rows. Scoring needs no shuffle; the model of half
    a megabyte is broadcast.
    """
    value = score_column(docs.sparkSession, model, F.col(text_col))
    out = docs.withColumns({"held_out": held_out(F.col(id_col), FOLDS, HELD), "score": value})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic; no column is added or changed."""
    return docs.where(score_column(docs.sparkSession, model, F.col(text_col)) < 0.5)


_SCORERS: dict = {}


def _scorer(shared):
    """One scorer for each model and worker, so its word table lasts from batch to batch."""
    if shared.value is not _SCORERS.get("model"):
        _SCORERS.update(model=shared.value, scorer=Scorer(shared.value))
    return _SCORERS["scorer"]
