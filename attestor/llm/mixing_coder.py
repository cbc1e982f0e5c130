"""Adaptive context-mixing range coder for token ids.

A block is coded from an empty model and is decoded without any other. Its ids are cut into lanes, even runs that share
the block's model and each have a range coder of their own; all lanes advance together, one id per step, as numpy
arrays. Only integer arithmetic is used and an array position written twice holds the last value, so encoder and decoder
agree on any machine.

Model. Order 2 and order 1 each predict one id, the one last confirmed in their context, with a confidence. Order 0 gives
every id met so far a part of the range by how often the other orders missed it, and the rest to new ids. For each joint
state of the two confidences, adaptive weights mix the three predictions into one distribution. Predictions change with
every id, counts and weights take effect at steps that double.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block at most, and in a lane at least where the block has more than one.
BLOCK, LANE = 1 << 20, 256
LANES = 4096
MIX_BITS, COUNT_BITS, TWO_BITS = 12, 16, 18
MOST_KNOWN = 1 << 15
#: Counts and weights are renewed at powers of two and then every so many steps.
RENEW = 64
CONFIDENT = 7
_32 = np.uint64(32)
_LOW = np.uint64(1 << 32)
_MASK = np.uint64((1 << 32) - 1)


class _Model:
    def __init__(self, alphabet: int, steps: int, lanes: int):
        self.one = np.zeros(alphabet + 1, np.int32)  # by the id before: (id + 1) << 3 | confidence, 0 where empty
        self.two = np.zeros(1 << TWO_BITS, np.int32)
        self.alphabet = alphabet
        state = np.arange(128)
        c1, c2, agree = state & 7, state >> 3 & 7, state >> 6
        self.by_two, self.by_one = c2 > 0, (c1 > 0) & (agree == 0)
        self.met = np.stack([self.by_two * c2, self.by_one * c1, np.full(128, 4)], axis=1).astype(np.int64)
        self.count = np.zeros(alphabet, np.int64)
        self.p1, self.p2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.ids = np.empty((steps, lanes), np.int32)
        self.ways = np.zeros((steps, lanes), np.int16)  # state * 4 + order that gave the id, 3 for lanes that have ended
        self.renewed, self.turn = 0, 0
        self.renew()

    def renew(self) -> None:
        ways, ids = self.ways[self.renewed : self.turn], self.ids[self.renewed : self.turn]
        self.renewed = self.turn
        self.met += np.bincount(ways.ravel(), minlength=512).reshape(128, 4)[:, :3]
        self.count += np.bincount(ids[ways & 3 == 2], minlength=self.alphabet)
        room = (1 << MIX_BITS) - 4
        total = self.met.sum(axis=1)
        two = self.by_two * (self.met[:, 0] * room // total + 1)
        self.upto2 = two.astype(np.uint64)
        self.upto1 = (two + self.by_one * (self.met[:, 1] * room // total + 1)).astype(np.uint64)
        known = np.flatnonzero(self.count)
        many = self.count[known]
        if len(known) > MOST_KNOWN:
            kept = np.sort(np.argsort(-many, kind="stable")[:MOST_KNOWN])
            known, many = known[kept], many[kept]
        total = int(many.sum())
        size = 1 << COUNT_BITS
        fresh = size if not total else min(size // 2, max(32, size * int(np.count_nonzero(many == 1)) // total))
        part = many * (size - fresh - len(known)) // max(total, 1) + 1
        part = np.concatenate(([size - int(part.sum())], part))  # the first is that of new ids
        self.known = np.concatenate(([0], known)).astype(np.int32)
        self.place = np.zeros(self.alphabet, np.int32)
        self.place[known] = np.arange(1, len(known) + 1)
        self.part = part.astype(np.uint64)
        self.start = (np.cumsum(part) - part).astype(np.uint64)
        self.at = np.repeat(np.arange(len(part), dtype=np.uint16), part)

    def predict(self) -> None:
        self.i2 = ((self.p1 * np.int32(40503 * 13) ^ self.p2 * np.int32(52711 * 29)) >> np.int32(5)) & np.int32((1 << TWO_BITS) - 1)
        self.e1, self.e2 = self.one.take(self.p1), self.two.take(self.i2)
        self.c1, self.c2 = self.e1 & 7, self.e2 & 7
        self.s1, self.s2 = self.e1 >> 3, self.e2 >> 3  # id + 1
        self.state = (self.c2 << 3) + self.c1 + ((self.s1 == self.s2).view(np.int8).astype(np.int32) << 6)
        self.f2, self.f1 = self.upto2.take(self.state), self.upto1.take(self.state)

    def learn(self, named: np.ndarray, way: np.ndarray) -> None:
        """``named``: id + 1 of each lane."""
        k = len(named)
        self.ids[self.turn, :k] = named - 1
        self.ways[self.turn, :k] = (self.state << 2) + way
        self.ways[self.turn, k:] = 3
        fresh = (named << 3) + 1
        self.one[self.p1] = np.where(self.s1 == named, self.e1 + (self.c1 < CONFIDENT), np.where(self.c1 > 3, self.e1 - 2, fresh))
        self.two[self.i2] = np.where(self.s2 == named, self.e2 + (self.c2 < CONFIDENT), np.where(self.c2 > 3, self.e2 - 2, fresh))
        self.p2, self.p1 = self.p1, named
        self.turn += 1
        t = self.turn
        if t & (t - 1) == 0 or t % RENEW == 0:
            self.renew()

    def end(self, k: int) -> None:
        """Only the first k lanes go on."""
        self.p1, self.p2 = self.p1[:k], self.p2[:k]


def lane_lengths(total: int) -> np.ndarray:
    lanes = max(1, min(LANES, total // LANE))
    return total // lanes + (np.arange(lanes) < total % lanes)


class _Out:
    """The coders' words: low is 64 bits wide, a carry goes back into the words written."""

    def __init__(self, lanes: int, room: int):
        self.words, self.room = np.zeros(lanes * room, np.uint32), room
        self.at = np.arange(lanes) * room
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def add(self, lanes, amount) -> None:
        low = self.low[lanes] + amount
        carry = np.flatnonzero(low < amount)
        self.low[lanes] = low
        if len(carry):
            back = self.at[lanes][carry] - 1
            while len(back):
                self.words[back] += np.uint32(1)
                back = back[self.words[back] == 0] - 1

    def shift(self, lanes) -> None:
        self.words[self.at[lanes]] = (self.low[lanes] >> _32).astype(np.uint32)
        self.at[lanes] += 1
        self.low[lanes] <<= _32
        self.range[lanes] <<= _32


def encode_block(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, all words) of one block of at least one id."""
    lengths = lane_lengths(len(ids))
    n, steps = len(lengths), int(lengths[0])
    full = int(lengths[-1])
    starts = np.cumsum(lengths) - lengths
    grid = np.zeros((steps, n), np.int32)
    for t in range(steps):
        k = n if t < full else int(np.count_nonzero(lengths > t))
        grid[t, :k] = ids[starts[:k] + t] + 1
    model, out = _Model(alphabet, steps, n), _Out(n, 2 * steps + 4)
    size = np.uint64(alphabet)
    for t in range(steps):
        k = n if t < full else int(np.count_nonzero(lengths > t))
        if k < len(model.p1):
            model.end(k)
        named = grid[t, :k]
        model.predict()
        hit2 = model.s2 == named
        hit1 = (model.s1 == named) & ~hit2
        way = np.where(hit2, 0, 2 - hit1.view(np.int8)).astype(np.int32)
        own = out.range[:k]
        unit = own >> np.uint64(MIX_BITS)
        b2, b1 = unit * model.f2, unit * model.f1
        low = np.where(hit2, np.uint64(0), np.where(hit1, b2, b1))
        own[:] = np.where(hit2, b2, np.where(hit1, b1, own)) - low
        z = np.flatnonzero(way == 2)
        place = model.place.take(named[z] - 1)
        unit = own[z] >> np.uint64(COUNT_BITS)
        low[z] += unit * model.start.take(place)
        own[z] = unit * model.part.take(place)
        out.add(slice(0, k), low)
        new = z[place == 0]
        if len(new):
            out.shift(new[own[new] < _LOW])
            unit = own[new] // size
            out.add(new, unit * (named[new] - 1).astype(np.uint64))
            own[new] = unit
        out.shift(np.flatnonzero(own < _LOW))
        model.learn(named, way)
    # one word more says enough where the range still holds a whole word, else two
    up = (out.low + _MASK) & ~_MASK
    short = (up >= out.low) & (up - out.low + _MASK < out.range) & (out.range > _LOW)
    exact = np.where(short, up, out.low)
    out.words[out.at] = (exact >> _32).astype(np.uint32)
    out.at += 1
    rest = np.flatnonzero(~short)
    out.words[out.at[rest]] = (exact[rest] & _MASK).astype(np.uint32)
    out.at[rest] += 1
    used = out.at - np.arange(n) * out.room
    held = np.arange(out.room)[None, :] < used[:, None]
    return used, out.words.reshape(n, out.room)[held]


def decode_block(used: np.ndarray, words: np.ndarray, total: int, alphabet: int) -> np.ndarray:
    lengths = lane_lengths(total)
    n, steps = len(lengths), int(lengths[0])
    full = int(lengths[-1])
    model = _Model(alphabet, steps, n)
    words = np.concatenate([words, np.zeros(4, np.uint32)])
    at = np.cumsum(used) - used
    last = len(words) - 1
    code = words[at].astype(np.uint64) << _32 | words[np.minimum(at + 1, last)]
    at += 2
    size = np.uint64(alphabet)
    own = np.full(n, (1 << 64) - 1, np.uint64)

    def shift(lanes):
        a = at[lanes]
        code[lanes] = code[lanes] << _32 | words.take(np.minimum(a, last))
        at[lanes] = a + 1
        own[lanes] <<= _32

    for t in range(steps):
        k = n if t < full else int(np.count_nonzero(lengths > t))
        if k < len(model.p1):
            model.end(k)
            own, code, at = own[:k], code[:k], at[:k]
        model.predict()
        unit = own >> np.uint64(MIX_BITS)
        b2, b1 = unit * model.f2, unit * model.f1
        hit2 = code < b2
        hit1 = (code < b1) & ~hit2
        way = np.where(hit2, 0, 2 - hit1.view(np.int8)).astype(np.int32)
        low = np.where(hit2, np.uint64(0), np.where(hit1, b2, b1))
        code -= low
        own[:] = np.where(hit2, b2, np.where(hit1, b1, own)) - low
        named = np.where(hit2, model.s2, model.s1)
        z = np.flatnonzero(way == 2)
        unit = own[z] >> np.uint64(COUNT_BITS)
        value = code[z]
        place = model.at.take(np.minimum(value // unit, np.uint64((1 << COUNT_BITS) - 1)).astype(np.int64))
        code[z] = value - unit * model.start.take(place)
        own[z] = unit * model.part.take(place)
        named[z] = model.known.take(place) + 1
        new = z[place == 0]
        if len(new):
            shift(new[own[new] < _LOW])
            unit = own[new] // size
            raw = np.minimum(code[new] // unit, size - np.uint64(1))
            code[new] -= raw * unit
            own[new] = unit
            named[new] = raw.astype(np.int32) + 1
        shift(np.flatnonzero(own < _LOW))
        model.learn(named, way)
    out = np.empty(total, np.int32)
    starts = np.cumsum(lengths) - lengths
    for t in range(steps):
        k = n if t < full else int(np.count_nonzero(lengths > t))
        out[starts[:k] + t] = model.ids[t, :k]
    return out
