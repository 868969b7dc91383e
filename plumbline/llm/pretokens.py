"""Encoding through a table of pre-tokens.

Byte-level and SentencePiece BPE never merge across certain boundaries. Texts are cut there, each piece is hashed,
and its ids come from a table; pieces that are not there are encoded once with the tokenizer's own library and
kept. A table holds at most `capacity` pieces and is then begun anew, so a worker's memory is bounded. Every piece
keeps its bytes, compared on each hit, so ids never depend on a hash.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from plumbline.llm.hashtable import HashTable
from plumbline.llm.textscan import SPACE, Hasher, owners, runs, same_bytes

CAPACITY = 1 << 18
LETTERS = 1 << 26


class PieceTable:
    """Ids of pieces by hash. `encode` turns a list of byte strings into lists of ids."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], capacity: int = CAPACITY):
        self.encode, self.capacity = encode, capacity
        self._clear()

    def _clear(self) -> None:
        self.table = HashTable()
        self.letters = np.zeros(0, np.uint8)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions of the pieces in the table, after adding those it lacked."""
        keys = Hasher(data).of(starts, ends)
        if len(self.size) > self.capacity or len(self.letters) > LETTERS:
            self._clear()
        found = self.table.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(np.maximum(keys[missing], np.uint64(1)), return_index=True)
            first = missing[first]
            base = self._append(data, starts[first], ends[first])
            self.table.add(new, base + np.arange(len(new)))
            found[missing] = self.table.find(keys[missing])
        size = ends - starts
        right = self.size[found] == size
        fits = np.flatnonzero(right)
        right[fits] = same_bytes(data, starts[fits], self.letters, self.at[found[fits]], size[fits])
        wrong = np.flatnonzero(~right)
        if len(wrong):  # same hash, other piece: kept outside the hash table, by position only
            found[wrong] = self._append(data, starts[wrong], ends[wrong]) + np.arange(len(wrong))
        return found

    def _append(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int:
        """Adds the spans as pieces and gives the position of the first."""
        base, raw = len(self.size), data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = self.encode(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        size = ends - starts
        self.at = np.concatenate([self.at, len(self.letters) + np.cumsum(size) - size])
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(pieces), np.uint8)])
        self.size = np.concatenate([self.size, size])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat])
        return base

    def lengths(self, slots: np.ndarray) -> np.ndarray:
        return self.begin[slots + 1] - self.begin[slots]

    def gather(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the pieces, one after the other."""
        size = self.lengths(slots)
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return self.ids[np.arange(total) + np.repeat(self.begin[slots] - (stop - size), size)]


# Classes of bytes for the byte-level pattern: 0 other, 1 letter, 2 digit, 3 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[SPACE] = 3
_CLASS[[0x1C, 0x1D, 0x1E, 0x1F]] = 0
# Two-byte characters U+00C0 to U+024F are letters but for the signs of multiplication and division.
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xCA] = True
_APOSTROPHE = ord("'")
_PAIRS = np.zeros((256, 256), bool)
for _a, _b in ("re", "ve", "ll"):
    _PAIRS[ord(_a), ord(_b)] = True


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents made of ASCII without the separators U+001C to U+001F, and of the letters U+00C0 to U+024F."""
    odd = (data >= 0x80) & (data < 0xC0)
    odd[1:] &= ~_LEADS[data[:-1]]
    odd |= (data >= 0xC0) & ~_LEADS[data]
    odd |= (data >= 0x1C) & (data <= 0x1F)
    if len(data) > 1:
        sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= sign
    total = np.concatenate([[0], np.cumsum(odd)])
    return total[offsets[1:]] == total[offsets[:-1]]


def byte_level_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern in plain texts; each ends where the next one starts.

    A piece is an optional space with a run of letters, of digits or of others, a contraction, or white space; the
    last character of a run of white space goes with what follows if it is a space, and else stands alone.
    """
    n = len(data)
    kind = _CLASS[data]
    kind[data >= 0x80] = 1
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, np.uint8)
    before[0] = 9
    before[1:] = kind[:-1]
    before[first] = 9
    after = np.empty(n, np.uint8)
    after[-1] = 9
    after[:-1] = kind[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = 9
    blank = kind == 3
    start = kind != before
    # A word that follows a single space begins at the space.
    glued = np.zeros(n, bool)
    glued[1:] = start[1:] & ~blank[1:] & (data[:-1] == 0x20) & ~first[1:]
    start &= ~glued
    # The last of a run of white space is a piece of its own, or the head of the next.
    start |= blank & (after != 3) & (after != 9)
    quotes = np.flatnonzero((data == _APOSTROPHE) & start)
    if len(quotes):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        limit = offsets[owners(quotes, offsets) + 1]
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = ((one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))) & (quotes + 1 < limit)
        double = ~single & _PAIRS[one, two] & (quotes + 2 < limit)
        start[quotes[single | double] + 1] = False
        for at, width in ((quotes[single], 2), (quotes[double], 3)):
            stop = at + width
            start[stop[stop < n]] = True
    return np.flatnonzero(start)


def one_thread() -> None:
    """The tokenizers library must not start threads of its own inside a Spark task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def space_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of runs of spaces with what follows, and of documents."""
    return runs(data == 0x20, offsets)[0]
