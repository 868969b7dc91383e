"""Open-addressing table from 64-bit hashes to integers, with vectorised look-up and insertion."""

from __future__ import annotations

import numpy as np


class HashTable:
    """Keys are 64-bit hashes; 0 marks a free slot, so key 0 counts as 1. At most half of the slots are used."""

    def __init__(self, size: int = 1 << 12):
        slots = 1 << max(4, int(2 * size - 1).bit_length())
        self.keys = np.zeros(slots, np.uint64)
        self.values = np.zeros(slots, np.int64)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        keys = np.maximum(keys, np.uint64(1))
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (there != 0)
            left, at = left[more], at[more]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and new."""
        keys = np.maximum(keys, np.uint64(1))
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != 0
            old_keys, old_values = self.keys[full], self.values[full]
            self.__init__(2 * (self.used + len(keys)))
            self._put(old_keys, old_values)
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        self.used += len(keys)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several keys for one slot, one stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & mask
