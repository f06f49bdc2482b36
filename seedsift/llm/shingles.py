"""Hashes of the word shingles of many texts at once, of long texts piece by piece."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from seedsift.llm.xxh64 import hash_slices

PIECE_BYTES = 1 << 20  # of a text that is held as words at once

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, words: int, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The words of a text, A-Z lower-cased, joined by one space; cut into pieces that share
    ``words - 1`` words, so that every shingle lies in exactly one of them. Nothing for a text
    without a word."""
    held: list[bytes] = []
    fresh = False
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        found = text[at:end].lower().split()
        at = end
        held += found
        fresh |= bool(found)
        if fresh and (len(held) >= words or at >= len(text)):
            yield b" ".join(held)
            held, fresh = held[len(held) - words + 1 :] if words > 1 else [], False
    if fresh and held:
        yield b" ".join(held)


def hashes(plain: list[bytes], words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of texts that ``pieces`` gave, one after another, and how many each
    has: with fewer words the whole is the only one."""
    joined = b"\n".join(plain)
    data = np.frombuffer(joined + bytes(8), np.uint8)
    gaps = np.flatnonzero((data[: len(joined)] == 32) | (data[: len(joined)] == 10))
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    counts = np.array([p.count(b" ") + 1 for p in plain], np.int64)
    first_word = np.cumsum(counts) - counts
    shingles = np.maximum(counts - words + 1, 1)
    first = np.cumsum(shingles) - shingles
    at = np.arange(int(shingles.sum())) - np.repeat(first - first_word, shingles)
    last = at + np.repeat(np.minimum(counts, words) - 1, shingles)
    return hash_slices(data, starts[at], ends[last] - starts[at], seed), shingles


def grouped(
    texts: list[bytes], words: int, seed: int, size: int = PIECE_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, hashes, counts) for groups of pieces of about ``size`` bytes: of which text each
    piece is, the hashes of all its shingles one after another, and how many each piece has."""
    of: list[int] = []
    plain: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        for piece in pieces(text, words, size):
            of.append(i)
            plain.append(piece)
            held += len(piece)
            if held >= size:
                yield np.array(of), *hashes(plain, words, seed)
                of, plain, held = [], [], 0
    if plain:
        yield np.array(of), *hashes(plain, words, seed)
