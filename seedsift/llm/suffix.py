"""Longest-previous-factor arrays in numpy."""

from __future__ import annotations

import numpy as np

DEPTHS = (8, 16, 32, 64, 128, 256)


def prefix_ranks(data: np.ndarray) -> list[np.ndarray]:
    """For each depth the rank of every position's prefix of that length; the data go on with
    zeros beyond their end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : n + k].astype(np.uint64)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    for depth in DEPTHS[:-1]:
        here = ranks[-1]
        there = np.zeros(n, np.int64)
        if depth < n:
            there[: n - depth] = here[depth:] + 1
        ranks.append(np.unique(here * (n + 1) + there, return_inverse=True)[1].astype(np.int64))
    return ranks


def common_prefix(
    data: np.ndarray, ranks: list[np.ndarray], one: np.ndarray, two: np.ndarray
) -> np.ndarray:
    """Lengths of the common prefixes of pairs of positions, up to twice the largest depth."""
    n = len(data)
    one, two = one.copy(), two.copy()
    length = np.zeros(len(one), np.int64)
    for depth, rank in zip(reversed(DEPTHS), reversed(ranks)):
        inside = (one + depth <= n) & (two + depth <= n)
        same = inside & (rank[np.minimum(one, n - 1)] == rank[np.minimum(two, n - 1)])
        step = np.where(same, depth, 0)
        one, two, length = one + step, two + step, length + step
    open_ = np.ones(len(one), bool)
    for _ in range(DEPTHS[0] - 1):
        open_ &= (one < n) & (two < n)
        open_ &= data[np.minimum(one, n - 1)] == data[np.minimum(two, n - 1)]
        one, two, length = one + open_, two + open_, length + open_
    return length


def smaller_before(order: np.ndarray) -> np.ndarray:
    """For each place of ``order`` the nearest place before it with a smaller entry, or -1."""
    n = len(order)
    before = np.arange(-1, n - 1)
    entry = np.append(order, -1)  # what place -1 reads
    # Hop over places known to be larger, several at once as their own answers fill in.
    live = np.flatnonzero(entry[before] > order)
    while len(live):
        before[live] = before[before[live]]
        live = live[entry[before[live]] > order[live]]
    return before


def longest_previous_factors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, source): the longest factor at each position that also starts further left, as far
    as 256 bytes decide the suffix order, and where; source -1 where there is none.

    In suffix order, the candidates for a position are only the nearest smaller positions before
    and after it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ranks = prefix_ranks(data)
    order = np.lexsort((np.arange(n), ranks[-1]))
    previous = smaller_before(order)
    following = n - 1 - smaller_before(order[::-1])[::-1]
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for side, there in ((previous, previous >= 0), (following, following < n)):
        at = np.flatnonzero(there)
        here, left = order[at], order[side[at]]
        found = common_prefix(data, ranks, here, left)
        better = found > length[here]
        length[here[better]], source[here[better]] = found[better], left[better]
    return length, source
