"""A read-only map from integers to integers that answers whole arrays at once."""

from __future__ import annotations

import numpy as np

EMPTY = np.int64(-1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """Open addressing over numpy arrays; keys are unique and not negative."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY, np.int64)
        self.values = np.full(1 << bits, default, np.int32)
        self.default = default
        keys = np.asarray(keys, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == EMPTY
            _, first = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[slot[taken]] = keys[left[taken]]
            self.values[slot[taken]] = values[left[taken]]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(self.default))
        again = np.flatnonzero((held != keys) & (held != EMPTY))
        slot = slot[again]
        while len(again):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[again]
            out[again[hit]] = self.values[slot[hit]]
            more = ~hit & (held != EMPTY)
            again, slot = again[more], slot[more]
        return out
