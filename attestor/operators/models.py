"""Models as column functions: loaded once in each worker, applied to Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from importlib import import_module

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def loaded(loader: str, name: str):
    """The model that ``loader`` (``module:function``) gives for ``name``; each worker asks once."""
    module, _, function = loader.partition(":")
    return getattr(import_module(module), function)(name)


@dataclass(frozen=True)
class EmbeddingModel:
    """A sentence embedder. ``loader`` names a function that returns, for ``name``, a function from a list of texts to a
    matrix of ``dims`` columns; it is imported on the workers, so nothing but its name travels."""

    name: str
    loader: str
    dims: int = 384
    batch: int = 64
    normalise: bool = True

    def __call__(self, text: Column) -> Column:
        """Embeddings of a text column, ``batch`` texts at a time; null, empty and blank texts are zero vectors."""
        model = self

        @F.pandas_udf("array<double>")
        def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = loaded(model.loader, model.name)
            for texts in series:
                yield pd.Series(list(model.encode(texts.tolist(), encode)), index=texts.index, dtype=object)

        return embed(text)

    def encode(self, texts: list[str | None], encode: Callable | None = None) -> np.ndarray:
        encode = encode or loaded(self.loader, self.name)
        out = np.zeros((len(texts), self.dims))
        stripped = [(t or "").strip() for t in texts]
        full = [k for k, t in enumerate(stripped) if t]
        for at in range(0, len(full), self.batch):
            own = full[at : at + self.batch]
            out[own] = np.asarray(encode([stripped[k] for k in own]), np.float64)
        if self.normalise:
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm > 0, norm, 1.0)
        return out


@dataclass(frozen=True)
class SequenceModel:
    """A classifier of texts. ``loader`` names a function that returns a function from a list of texts to a matrix of
    logits, one column for each of ``labels``."""

    name: str
    loader: str
    labels: tuple[str, ...] = ("fake", "real")
    batch: int = 16

    def __call__(self, text: Column) -> Column:
        """``array<struct<label, score>>``: the softmax of a text's logits, in the order of ``labels``."""
        model = self

        @F.pandas_udf("array<struct<label:string,score:double>>")
        def classify(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = loaded(model.loader, model.name)
            for texts in series:
                rows = model.probabilities(texts.tolist(), score)
                yield pd.Series([[{"label": n, "score": float(p)} for n, p in zip(model.labels, row)] for row in rows], index=texts.index, dtype=object)

        return classify(text)

    def probabilities(self, texts: list[str | None], score: Callable | None = None) -> np.ndarray:
        score = score or loaded(self.loader, self.name)
        out = np.empty((len(texts), len(self.labels)))
        for at in range(0, len(texts), self.batch):
            logits = np.asarray(score([t or "" for t in texts[at : at + self.batch]]), np.float64)
            spread = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[at : at + self.batch] = spread / spread.sum(axis=1, keepdims=True)
        return out


@dataclass(frozen=True)
class LanguageModel:
    """A parser of sentences for the claim detector. ``loader`` names a function that returns a function from a list of
    texts to (entities, indicative, modal, has_subject) of each."""

    name: str
    loader: str
    fields: str = field(default="struct<entities:array<string>,indicative:boolean,modal:boolean,has_subject:boolean>", repr=False)

    def __call__(self, text: Column) -> Column:
        model = self

        @F.pandas_udf(self.fields)
        def parse(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = loaded(model.loader, model.name)
            for texts in series:
                rows = own(["" if t is None else t for t in texts])
                yield pd.DataFrame(rows, columns=["entities", "indicative", "modal", "has_subject"], index=texts.index)

        return parse(text)
