"""Projections, kd-trees and the search within one block of vectors, in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

PROJECTED = 8  # even
CONFIDENCE = 0.95
BUCKET = 64


def chi_square(x: np.ndarray | float, degrees: int = PROJECTED) -> np.ndarray | float:
    """Distribution function of chi-square with an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, degrees: int = PROJECTED) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def projection(dims: int, seed: int) -> np.ndarray:
    """Directions of a 2-stable (normal) distribution: the squared distance of two projected
    points is their squared distance times a chi-square variable."""
    return np.random.default_rng(seed).normal(size=(dims, PROJECTED))


def raised(vectors: np.ndarray, largest: float) -> np.ndarray:
    """One more coordinate that brings every vector to the length of the largest, so that the
    nearest to a query with 0 there is the one with the largest inner product."""
    rest = np.maximum(largest - (vectors**2).sum(1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1)


@dataclass
class Splits:
    """A kd-tree over projected points: inner nodes in order of a complete binary tree."""

    axis: np.ndarray
    at: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.axis) + 1

    @staticmethod
    def of(points: np.ndarray, leaves: int) -> Splits:
        """Splits at medians, along the widest axis; ``leaves`` is a power of two."""
        axis, at = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
        groups = [np.arange(len(points))]
        for node in range(leaves - 1):
            rows = groups[node]
            if len(rows):
                here = points[rows]
                axis[node] = np.argmax(here.max(0) - here.min(0))
                at[node] = np.median(here[:, axis[node]])
            right = points[rows, axis[node]] >= at[node]
            groups += [rows[~right], rows[right]]
        return Splits(axis, at)


def assign(splits: Splits, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    inner = len(splits.axis)
    while inner and len(node) and node[0] < inner:
        right = points[np.arange(len(points)), splits.axis[node]] >= splits.at[node]
        node = 2 * node + 1 + right
    return node - inner


def boxes(points: np.ndarray, leaf: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of what lies in each leaf; of an empty one, infinitely far."""
    low = np.full((leaves, points.shape[1]), np.inf)
    high = np.full((leaves, points.shape[1]), -np.inf)
    np.minimum.at(low, leaf, points)
    np.maximum.at(high, leaf, points)
    return low, high


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    with np.errstate(invalid="ignore"):
        apart = np.maximum(np.maximum(low - point, point - high), 0)
        return (apart**2).sum(1)


def largest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` largest scores, unordered; of equal ones those with smaller ids."""
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > cut)
    ties = np.flatnonzero(scores == cut)
    if len(above) + len(ties) > k:
        ties = ties[np.argsort(ids[ties], kind="stable")[: k - len(above)]]
    return np.concatenate([above, ties])


class Block:
    """A block of vectors, indexed by a kd-tree over their projections."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray, ids: np.ndarray | None = None):
        leaves = 1 << max(0, math.ceil(math.log2(max(len(points), 1) / BUCKET)))
        splits = Splits.of(points, leaves)
        leaf = assign(splits, points)
        self.order = np.argsort(leaf, kind="stable")
        self.stops = np.cumsum(np.bincount(leaf, minlength=leaves))
        self.low, self.high = boxes(points, leaf, leaves)
        self.vectors = vectors[self.order]
        self.ids = self.order if ids is None else ids[self.order]

    def nearest(
        self,
        query: np.ndarray,
        point: np.ndarray,
        k: int,
        base: float,
        quantile: float,
        bound: float = -np.inf,
    ) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` largest inner products found, unordered; of equal ones those
        with smaller ids.

        Buckets come in order of projected distance and are verified in full. ``base`` is the
        squared length of the query plus that of the longest vector, so that ``base - 2 * score``
        is a squared distance. The search stops when all that is left lies so far off in the
        projection that the chi-square test rejects its being nearer than the k-th found;
        ``bound`` is a k-th score known from elsewhere.
        """
        far = box_distance(self.low, self.high, point)
        order = np.argsort(far, kind="stable")
        rows, scores = np.zeros(0, np.int64), np.zeros(0)
        taken, step = 0, 8
        while taken < len(order):
            kth = bound
            if len(scores) >= k:
                kth = max(bound, scores.min())
            if far[order[taken]] > quantile * max(base - 2 * kth, 0):
                break
            part = order[taken : taken + step]
            ends = self.stops[part]
            starts = np.where(part > 0, self.stops[part - 1], 0)
            at = np.concatenate([np.arange(i, j) for i, j in zip(starts, ends)])
            found = (self.vectors[at] * query).sum(1)
            rows, scores = np.append(rows, at), np.append(scores, found)
            if len(scores) > k:
                best = largest(scores, self.ids[rows], k)
                rows, scores = rows[best], scores[best]
            taken += step
            step *= 2
        return self.order[rows], scores
