"""Word vectors by random indexing, and pooling them per document, in numpy."""

from __future__ import annotations

import numpy as np

BUCKETS_LOG2 = 15
DIMS = 32
NONZERO = 4
WINDOW = 2
POOLED = 2 * DIMS + 2
SEED = 7

# Class of each byte: 0 white space, 1 letter (also every byte of a letter beyond ASCII), 2 digit,
# 3 sign. A word is a run of one class.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[128:] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*range(9, 14), 32]] = 0


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word of the texts that are laid end to end in ``data``."""
    kind = _CLASS[data]
    head = np.ones(len(data), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[ends[:-1][ends[:-1] < len(data)]] = True
    heads = np.flatnonzero(head)
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(data)))
    place = np.arange(len(data)) - np.repeat(heads, sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()), np.uint64(0x5851F42D4C957F2D)))
        total = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], heads)
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (total >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    real = kind[heads] != 0
    return bucket[real], np.searchsorted(ends, heads[real], side="right")


def index_vectors() -> np.ndarray:
    """The fixed sparse random vectors, one per bucket; row -1 is that of no word."""
    rng = np.random.default_rng(SEED)
    n = 1 << BUCKETS_LOG2
    out = np.zeros((n + 1, DIMS), np.int16)
    at = rng.integers(0, DIMS, (n, NONZERO))
    sign = rng.choice(np.array([-1, 1], np.int16), (n, NONZERO))
    np.add.at(out, (np.arange(n)[:, None], at), sign)
    return out


def add_contexts(total: np.ndarray, index: np.ndarray, bucket: np.ndarray, text: np.ndarray):
    """Adds to each word's row of ``total`` the index vectors of its neighbours."""
    n = len(bucket)
    if not n:
        return
    context = np.zeros((n, DIMS), np.int16)
    for step in range(1, min(WINDOW, n - 1) + 1):
        same = text[step:] == text[:-step]
        context[step:] += index[np.where(same, bucket[:-step], -1)]
        context[:-step] += index[np.where(same, bucket[step:], -1)]
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total[ordered[heads]] += np.add.reduceat(context[order], heads, axis=0, dtype=np.int64)


def unit_rows(total: np.ndarray) -> np.ndarray:
    size = np.sqrt((total.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (total / np.maximum(size, 1)).astype(np.float32)


def pooled(vectors: np.ndarray, bucket: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Mean and spread of the word vectors of each of ``n`` texts, how far neighbouring words lie
    apart on average, and the logarithm of the number of words; zeros for a text without words."""
    out = np.zeros((n, POOLED), np.float32)
    if not len(bucket):
        return out
    rows = vectors[bucket]
    heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    owner = text[heads]
    count = np.diff(np.append(heads, len(text)))[:, None]
    mean = np.add.reduceat(rows, heads, axis=0, dtype=np.float64) / count
    square = np.add.reduceat(rows * rows, heads, axis=0, dtype=np.float64) / count
    apart = np.zeros(len(bucket))
    apart[1:] = np.where(text[1:] == text[:-1], ((rows[1:] - rows[:-1]) ** 2).sum(1), 0)
    out[owner, :DIMS] = mean
    out[owner, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean**2, 0))
    out[owner, -1] = np.log(count[:, 0])
    out[owner, -2] = np.add.reduceat(apart, heads) / np.maximum(count[:, 0] - 1, 1)
    return out
