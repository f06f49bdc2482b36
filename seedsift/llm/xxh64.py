"""XXH64 of many slices of one buffer at once."""

from __future__ import annotations

import numpy as np

# Fixed values of the XXH64 specification.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def hash_slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The hashes of ``data[start : start + size]``; ``data`` ends with 8 spare bytes."""
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    halves = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    pos, left = starts.astype(np.int64), sizes.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(pos), np.uint64(seed) + P5, np.uint64)
        wide = np.flatnonzero(left >= 32)
        if len(wide):
            s = np.uint64(seed)
            lanes = [np.full(len(wide), v) for v in (s + P1 + P2, s + P2, s, s - P1)]
            live = np.arange(len(wide))
            while len(live):
                at = pos[wide[live]]
                for k in range(4):
                    lanes[k][live] = _round(lanes[k][live], words[at + 8 * k])
                pos[wide[live]] += 32
                left[wide[live]] -= 32
                live = live[left[wide[live]] >= 32]
            mixed = sum(_rotl(lane, r) for lane, r in zip(lanes, (1, 7, 12, 18)))
            for lane in lanes:
                mixed = (mixed ^ _round(np.zeros_like(lane), lane)) * P1 + P4
            h[wide] = mixed
        h += sizes.astype(np.uint64)
        while len(live := np.flatnonzero(left >= 8)):
            lane = _round(np.zeros(len(live), np.uint64), words[pos[live]])
            h[live] = _rotl(h[live] ^ lane, 27) * P1 + P4
            pos[live] += 8
            left[live] -= 8
        if len(live := np.flatnonzero(left >= 4)):
            h[live] = _rotl(h[live] ^ (halves[pos[live]].astype(np.uint64) * P1), 23) * P2 + P3
            pos[live] += 4
            left[live] -= 4
        while len(live := np.flatnonzero(left > 0)):
            h[live] = _rotl(h[live] ^ (data[pos[live]].astype(np.uint64) * P5), 11) * P1
            pos[live] += 1
            left[live] -= 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
