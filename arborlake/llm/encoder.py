"""Whole texts to token ids with the tokenizers library, each distinct stretch encoded once.

Both public vocabularies split a text before merging, and a merge never crosses a split. Hence a text
may be cut at places that are always splits, each distinct stretch encoded by the library once, and the
ids put together again; the result equals the library's for the whole text (tests compare them).

- word vocabulary: white space is dropped and separates words, so stretches lie between white space;
- byte vocabulary: a run of white space opens a new split, so a stretch is such a run with what follows it;
- both: a full stop or comma after a letter opens a new split, so a word is one stretch with or without it.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Stretches kept by one worker, half of them as an older table; which are kept changes no result.
KEPT = 500_000
_SPACED = re.compile(r"\s*+[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\s.,])|\s*+\S++|\s+")
_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\s.,])|\S+")
#: Stretches that begin with white space and do not end with it.
_PLAIN = re.compile(r"[ \t\n\r](?s:.*)\S\Z")
#: Python's white space but not the vocabulary's: texts with these are encoded in one stretch.
_ODD = re.compile("[\x1c-\x1f]")
#: White space beyond ASCII, as the number that its UTF-8 bytes make.
_WIDE = np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))])
_encoders: dict = {}


def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def stretches(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The stretches of all texts in a row for the byte vocabulary, and how many end by the end of each text.

    Works on the column's UTF-8 bytes, so no Python string is made for a stretch that is there twice. Cuts lie
    before white space of ASCII that follows other characters, and before a full stop or comma after a letter.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    x = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space, stop, lower = (x == 32) | (x - np.uint8(9) < 5), (x == 44) | (x == 46), x | 32
    letter = (lower >= 97) & (lower <= 122)
    cut = np.zeros(len(x), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | (stop[1:] & letter[:-1])
    beyond = np.flatnonzero((x[:-1] >= 128) & (space | stop)[1:]) + 1  # valid UTF-8, so two bytes before these are there
    last = x[beyond - 2].astype(np.int64) << 8 | x[beyond - 1]
    wide = np.isin(last, _WIDE) | np.isin(x[beyond - 3].astype(np.int64) << 16 | last, _WIDE)
    latin = (last >= 0xC380) & (last <= 0xC3BF) & (last != 0xC397) & (last != 0xC3B7)
    cut[beyond] = np.where(space[beyond], ~wide, latin)
    cut[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    at = np.append(np.flatnonzero(cut), len(x))
    found = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(x))
    return found.dictionary_encode(), np.searchsorted(at, offsets[1:])


class _Index(dict):
    """The row of each stretch; one that is looked up and not there gets the next row and is noted as fresh."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, stretch: str) -> int:
        self.fresh.append(stretch)
        row = self[stretch] = len(self)
        return row


class Encoder:
    def __init__(self, path: str, offsets: bool = False, kept: int = KEPT) -> None:
        self.tokenizer, self.offsets, self.kept = tokenizer(path), offsets, kept
        self.spaced = self.tokenizer.normalizer is None  # the byte vocabulary keeps white space
        if self.spaced:  # a token's characters stand for its bytes
            self.bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes[i] = len(token)
        self.index = _Index()
        self._renew()

    def _renew(self) -> None:
        """Makes the table the older one; what is met again moves to the new one without the library."""
        self.older = (self.index, self.pool, self.spans, self.first, self.count) if self.index else ({}, *[None] * 4)
        self.index = _Index()
        self.used = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.spans = np.zeros((1 << 16, 2), np.int32) if self.offsets else None
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _split(self, text: str) -> list:
        if _ODD.search(text):
            return [text]
        if self.spaced:
            return _SPACED.findall(text)
        return _WORDS.findall(text if self.offsets else text.encode().lower().decode())

    def _encoded(self, fresh: list):
        """(ids, number of ids of each stretch, spans) of stretches, many in one call of the library."""
        if self.spaced:
            some = [fresh[i : i + 500] for i in range(0, len(fresh), 500)]
            done = self.tokenizer.encode_batch(some, is_pretokenized=True, add_special_tokens=False)
            of = [np.array(e.word_ids, np.int64) + 500 * i for i, e in enumerate(done)]
        else:
            some = [" ".join(fresh[i : i + 500]) for i in range(0, len(fresh), 500)]
            done = self.tokenizer.encode_batch(some, add_special_tokens=False)
            of = []
            for i, e in enumerate(done):
                size = np.fromiter(map(len, fresh[500 * i : 500 * i + 500]), np.int64) + 1
                starts = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
                of.append(np.searchsorted(np.cumsum(size) - size, starts, "right") - 1 + 500 * i)
        count = np.bincount(np.concatenate(of), minlength=len(fresh))
        spans = [s for e in done for s in e.offsets] if self.offsets else None
        return np.concatenate([np.array(e.ids, np.uint32) for e in done]), count, spans

    def _joined(self, fresh: list):
        """What _encoded() gives, without spans, for stretches of the byte vocabulary that may follow each other in a text."""
        some = [fresh[i : i + 500] for i in range(0, len(fresh), 500)]
        done = self.tokenizer.encode_batch_fast(list(map("".join, some)), add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in done])
        size = np.fromiter((len(w.encode()) for w in fresh), np.int64, len(fresh))
        after = np.concatenate([[0], np.cumsum(self.bytes[flat])])  # bytes before each token
        first = np.searchsorted(after, np.cumsum(size) - size)
        if after[-1] != size.sum() or (after[first] != np.cumsum(size) - size).any():
            return self._encoded(fresh)  # a vocabulary whose tokens are not their bytes
        return flat, np.diff(np.append(first, len(flat))), None

    def _moved(self, known: list):
        """What _encoded() gives, for stretches of the older table."""
        index, pool, spans, first, count = self.older
        row = np.fromiter(map(index.__getitem__, known), np.int64, len(known))
        size = count[row]
        at = np.repeat(first[row] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return pool[at], size, spans[at] if self.offsets else None

    def _learn(self, fresh: list) -> None:
        """Fills the last rows of the table, those of fresh."""
        older, at = self.older[0], np.arange(len(self.index) - len(fresh), len(self.index))
        known = np.fromiter(map(older.__contains__, fresh), bool, len(fresh)) if older else np.zeros(len(fresh), bool)
        while len(self.index) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        plain = np.zeros(len(fresh), bool)
        if self.spaced and not self.offsets:
            plain = np.fromiter(map(bool, map(_PLAIN.match, fresh)), bool, len(fresh)) & ~known
        for those, source in ((known, self._moved), (plain, self._joined), (~known & ~plain, self._encoded)):
            rows = at[those]
            table = fresh if len(rows) == len(fresh) else [fresh[i] for i in np.flatnonzero(those).tolist()]
            for i in range(0, len(rows), 20_000):
                self._keep(rows[i : i + 20_000], *source(table[i : i + 20_000]))

    def _keep(self, rows: np.ndarray, flat: np.ndarray, count: np.ndarray, spans) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            if self.offsets:
                self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.pool[self.used : self.used + len(flat)] = flat
        if self.offsets and len(flat):
            self.spans[self.used : self.used + len(flat)] = spans
        self.first[rows] = self.used + np.cumsum(count) - count
        self.count[rows] = count
        self.used += len(flat)

    def encode(self, texts: list[str]):
        """(ids of all texts in a row, number of ids of each text[, starts, ends in characters of the text])."""
        words: list = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words += self._split(text)
            ends[i + 1] = len(words)
        at, count, ids, lengths = self._ids(self._rows(words), ends)
        if not self.offsets:
            return ids, lengths
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        begin -= np.repeat(np.concatenate([begin, [size.sum()]])[ends[:-1]], np.diff(ends))
        moved = np.repeat(begin, count)
        return ids, lengths, self.spans[at, 0] + moved, self.spans[at, 1] + moved

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What encode() gives for the texts of a column, null as empty; in the byte vocabulary a stretch is looked up once."""
        if not self.spaced or self.offsets:
            return self.encode([t or "" for t in texts.to_pylist()])[:2]
        found, ends = stretches(texts)
        row = self._rows(found.dictionary.to_numpy(zero_copy_only=False).tolist())[found.indices.to_numpy()]
        return self._ids(row, np.append(0, ends))[2:]

    def _rows(self, words: list) -> np.ndarray:
        """The row of each stretch; new ones are learned."""
        if 2 * len(self.index) > self.kept:
            self._renew()
        row = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.fresh:
            fresh, self.index.fresh = self.index.fresh, []
            try:
                self._learn(fresh)
            except BaseException:
                self.index = _Index()  # rows that were not filled are never read
                self._renew()
                raise
        return row

    def _ids(self, row: np.ndarray, ends: np.ndarray):
        """(places in the pool, number of ids of each stretch, ids, number of ids of each text) of stretches in a row."""
        count = self.count[row]
        till = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first[row] - till[:-1], count)
        at += np.arange(len(at))
        return at, count, self.pool[at], np.diff(till[ends])


def encoder(path: str, offsets: bool = False, kept: int = KEPT) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if (path, offsets, kept) not in _encoders:
        _encoders[path, offsets, kept] = Encoder(path, offsets, kept)
    return _encoders[path, offsets, kept]
