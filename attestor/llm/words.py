"""Word memory for Python workers: each different word is worked out once per worker."""

from __future__ import annotations

import zlib

import numpy as np

_PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¿¡·"


def chunks_of(text: str | None) -> list[str]:
    """White-space separated pieces, lower-cased."""
    return (text or "").lower().split()


def clean(word: str) -> str:
    return word.strip(_PUNCT)


class WordTable:
    """Numbers words from 0 and keeps one value for each in arrays; forgets all when it is full, so its memory is
    bounded whatever the corpus holds."""

    def __init__(self, work_out, kinds, limit: int = 150_000):
        self.work_out, self.kinds, self.limit = work_out, kinds, limit
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.arrays = [np.empty(1024, k) for k in self.kinds]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers, valid until the next call."""
        if len(self.number) > self.limit:
            self.clear()
        get = self.number.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(words) and out.min() < 0:
            fresh = [w for w in dict.fromkeys(words) if w not in self.number]
            at = len(self.number)
            for k, w in enumerate(fresh):
                self.number[w] = at + k
            need = at + len(fresh)
            values = self.work_out(fresh)
            for i, (array, new) in enumerate(zip(self.arrays, values)):
                if need > len(array):
                    array = self.arrays[i] = np.concatenate([array[:at], np.empty(max(need, 2 * len(array)) - at, array.dtype)])
                array[at:need] = new
            out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        return out


def bucket(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % buckets


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam steps for a list of arrays. ``floor`` is added to the scale of a gradient: features whose gradients stay
    far below it, such as words of one text, hardly move and are not learnt by heart."""

    def __init__(self, params: list[np.ndarray], rate: float, floor: float = 1e-8):
        self.params, self.rate, self.floor, self.turn = params, rate, floor, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads):
        self.turn += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + self.floor)
