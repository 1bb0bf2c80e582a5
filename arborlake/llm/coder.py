"""A block coder for token ids: context mixing of order 0 to 2 drives a range coder.

A block starts from an empty model. Its ids lie in ``lanes`` of equal length, one range coder a lane, and
all lanes share one model, which learns from a whole step (one id of each lane) at a time; so every
operation is one numpy call over all lanes, and the decoder repeats exactly what the encoder did.

The model makes three predictions of the next id: one id by the last two ids (order 2), one by the last
id (order 1), and adaptive counts (order 0). The coder's range is shared out among them, by shares that are learned in 256
classes of the two predictions' confidence; an id takes its interval in the part of the highest order that
predicts it. So shares are mixed by context, but an id's interval is not the sum of its probabilities of all orders.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

HEAD = struct.Struct("<4sIIIIII")
MAGIC = b"CMR2"
_U = np.uint64
_TOP, _BOT, _16, _48 = _U(1 << 48), _U(1 << 44), _U(16), _U(48)
_SHARES = 1 << 12
#: Lanes of a block at most; a power of two.
_LANES = 1 << 13
_GAIN = 8
#: Ids that order 0 may lag behind at most; at first it lags less.
_LAG = 32_768


#: What is added to trust in a guess after a miss and after a hit; without trust it becomes 1 in both cases.
_TRUST = np.array([0, *((t >> 1) - t for t in range(1, 16)), 0, *(min(t + 1, 15) - t for t in range(1, 16))], np.int32)


class _Model:
    """Tables hold guess << 4 | trust. ``kind`` of a lane's id: its class of confidences, + 0 (order 2 predicts it), 256 (order 1) or 512."""

    def __init__(self, size: int, lanes: int) -> None:
        self.counts = np.ones(size, np.int32)  # at most 2**20 + 8 * 2**21 together
        self.cumulated = np.arange(size + 1, dtype=np.int32)
        self.total = size
        self.fresh: list[np.ndarray] = []
        self.waiting = self.learned = 0
        self.one, self.two = np.zeros(size, np.int32), np.zeros(1 << 18, np.int32)
        self.seen = np.repeat(np.array([2, 1, 2]), 256)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.low, self.size = np.zeros(768, np.int64), np.zeros(768, np.int64)
        self._share()

    def _share(self) -> None:
        """Where the interval of each kind begins and its size; from 512 on, its size for each count of order 0."""
        seen = self.seen.reshape(3, 256)
        share = seen[:2] * (_SHARES - 3)
        share //= seen.sum(0)
        share += 1
        np.multiply(share.ravel(), self.total, out=self.size[:512])
        self.low[256:512] = self.size[:256]
        np.add(self.size[:256], self.size[256:512], out=self.low[512:])
        np.subtract(_SHARES, share.sum(0), out=self.size[512:])

    def predict(self) -> None:
        """The guesses for the next id of each lane, and the class of their confidences."""
        self.at2 = self.last * 40503
        self.at2 ^= self.before
        self.at2 &= 0x3FFFF
        self.in1, self.in2 = self.one[self.last], self.two[self.at2]
        self.guess1, self.guess2 = self.in1 >> 4, self.in2 >> 4
        self.trust1, self.trust2 = self.in1 & 15, self.in2 & 15
        self.by = (self.trust2 << 4 | self.trust1).astype(np.int64)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.hit1, self.hit2 = self.guess1 == ids, self.guess2 == ids
        self.kind = np.where(self.hit2, self.by, self.by + np.where(self.hit1, 256, 512))
        low, size = self.low[self.kind], self.size[self.kind]
        rest = np.flatnonzero(~(self.hit1 | self.hit2))
        some = ids[rest]
        begin, f0 = self.cumulated[some], size[rest]
        low[rest] += f0 * begin
        size[rest] = f0 * self.counts[some]
        return low, size

    def find(self, value: np.ndarray) -> np.ndarray:
        out = np.where(value < self.size[self.by], self.guess2, self.guess1)
        value = value - self.low[512:][self.by]
        rest = np.flatnonzero(value >= 0)
        if len(rest):
            # in order of their values, with the place in the low bits: a search is faster when the last one was near
            share = value[rest] / self.size[512:][self.by[rest]]  # of numbers below 2**37, so rounded down it is exact
            keys = np.sort(share.astype(np.int64) * _LANES | np.arange(len(rest)))
            out[rest[keys & (_LANES - 1)]] = np.searchsorted(self.cumulated[1:-1], (keys // _LANES).astype(np.int32), "right")
        return out

    def learn(self, ids: np.ndarray) -> None:
        """What follows once interval() was asked for these ids."""
        self.seen += np.bincount(self.kind, minlength=768) * 4
        new = ids << 4 | 1
        for table, at, was, trust, hit in ((self.one, self.last, self.in1, self.trust1, self.hit1), (self.two, self.at2, self.in2, self.trust2, self.hit2)):
            now = (hit.view(np.int8) << 4 | trust).astype(np.int64)  # numpy is faster with indices of 64 bits
            table[at] = np.where(trust == 0, new, was + _TRUST[now])
        self.before = self.last * 60493
        self.last = ids.astype(np.int64)
        self.fresh.append(self.last)
        self.waiting += len(ids)
        if self.waiting >= min(_LAG, 1024 + self.learned // 8):
            self.counts += (_GAIN * np.bincount(np.concatenate(self.fresh), minlength=len(self.counts))).astype(np.int32)
            self.learned += self.waiting
            self.fresh, self.waiting = [], 0
            np.cumsum(self.counts, out=self.cumulated[1:])
            self.total = int(self.cumulated[-1])
        self._share()


def _moved(low: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lanes whose leading 16 bits are settled, and these bits, until there are none; only a lane that moved may move again."""
    at, some, wide = None, low, size
    while True:
        settled = (some ^ (some + wide)) < _TOP
        small = np.flatnonzero((wide < _BOT) > settled)
        if len(small):
            wide[small] = (_U(0) - some[small]) & (_BOT - _U(1))
            settled[small] = True
        those = np.flatnonzero(settled)
        if not len(those):
            return
        at = those if at is None else at[those]
        some, wide = some[those], wide[those]
        yield at, some >> _48
        some <<= _16
        wide <<= _16
        low[at], size[at] = some, wide


def encode(ids: np.ndarray) -> bytes:
    """One block of at most 2**21 ids below 2**20."""
    n = len(ids)
    lanes = min(_LANES, max(1, n // 64))
    steps = -(-n // lanes)
    size = int(ids.max()) + 1 if n else 1
    table = np.zeros(lanes * steps, np.int32)
    table[:n] = ids
    table = table.reshape(lanes, steps).T.copy()
    model, low, wide = _Model(size, lanes), np.zeros(lanes, _U), np.full(lanes, _U(0xFFFFFFFFFFFFFFFF))
    lane, word = [], []
    for row in table:
        model.predict()
        begin, share = model.interval(row)
        unit = wide // _U(model.total * _SHARES)
        low += unit * begin.view(_U)
        wide = unit * share.view(_U)
        for at, bits in _moved(low, wide):
            lane.append(at.astype(np.uint16))
            word.append(bits.astype("<u2"))
        model.learn(row)
    moves = sum(map(len, lane))
    for _ in range(4):
        lane.append(np.arange(lanes, dtype=np.uint16))
        word.append((low >> _48).astype("<u2"))
        low <<= _16
    # the decoder is four words of a lane ahead: it opens with four of each, then takes one a move, in the order of the moves
    lane, word = np.concatenate(lane), np.concatenate(word)
    order, counts = np.argsort(lane, kind="stable"), np.bincount(lane, minlength=lanes)
    word, at = word[order], np.flatnonzero(order < moves)
    later = np.empty(moves, "<u2")
    later[order[at]] = word[at + 4]
    body = word[np.cumsum(counts) - counts + np.arange(4)[:, None]].tobytes() + later.tobytes()
    return HEAD.pack(MAGIC, n, lanes, size, len(body), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if either checksum differs."""
    magic, n, lanes, size, length, crc, body_crc = HEAD.unpack_from(data)
    body = data[HEAD.size : HEAD.size + length]
    if magic != MAGIC or len(body) != length or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    words, taken = np.frombuffer(body, "<u2"), 4 * lanes
    steps = -(-n // lanes)
    model, low, wide = _Model(size, lanes), np.zeros(lanes, _U), np.full(lanes, _U(0xFFFFFFFFFFFFFFFF))
    code = np.zeros(lanes, _U)
    for some in words[:taken].reshape(4, lanes):
        code = code << _16 | some
    table = np.zeros((steps, lanes), np.int32)
    for row in table:
        model.predict()
        unit = wide // _U(model.total * _SHARES)
        value = ((code - low) // unit).view(np.int64)
        row[:] = model.find(value)
        begin, share = model.interval(row)
        low += unit * begin.view(_U)
        wide = unit * share.view(_U)
        for at, _ in _moved(low, wide):
            code[at] = code[at] << _16 | words[taken : taken + len(at)]
            taken += len(at)
        model.learn(row)
    ids = table.T.reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block")
    return ids
