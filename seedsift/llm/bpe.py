"""Byte-level BPE by speculation and verification.

A piece of text is first covered by the longest vocabulary entries from left to right. That guess
is the right encoding exactly when every two neighbours in it are compatible: merged on their own,
the two tokens' bytes must give just these two tokens again. All pieces that are new in a chunk of
texts are guessed together, all their neighbours are tested together, and only the pieces with a
failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import byte_chunks, map_batches, text_bytes
from seedsift.llm.intmap import IntMap

# Fixed value: how the vocabulary's tokenizer splits text before it merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The same for texts of Latin letters only, in a form that the standard library's engine can run.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LATIN = (
    rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+"
    r"|\s+(?!\S)|\s+"
)
NOT_LATIN = re.compile("[^\t-\r -~\xa0-ɏ]")
SHORT_PIECE = 48  # longer pieces are merged one by one
NO_MERGE = 1 << 30
CACHED_PIECES = 300_000
CACHED_PAIRS = 2_000_000
CACHED_PIECE_BYTES = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file, by its rule: printable
    bytes stand for themselves, the others for the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encodes pieces and decodes ids with the vocabulary of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in text) for text, i in vocab.items()}
        id_of = {text: i for i, text in self.bytes_of.items()}
        self.byte_ids = np.array([id_of[bytes([b])] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(vocab[one] << 32) | vocab[two] for one, two in merges]
        self.merged_id = np.array([vocab[one + two] for one, two in merges], np.int32)
        # Pair of ids -> rank of its merge.
        self.rank = IntMap(np.array(pairs), np.arange(len(pairs)), NO_MERGE)
        self.rank_of = {pair: rank for rank, pair in enumerate(pairs)}
        self._grow_tree(id_of)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        escaped = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.special_split = regex.compile(f"({escaped})") if escaped else None
        self.pattern, self.latin = regex.compile(PATTERN), re.compile(LATIN)
        self.id_text = {i: b"%d" % i for i in self.bytes_of}
        self.compatible: dict[int, bool] = {}
        # Per piece: its ids as decimal text, and what they decode to.
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def _grow_tree(self, id_of: dict[bytes, int]) -> None:
        """The vocabulary as a prefix tree: (node, byte) -> node, and the id that ends in a node."""
        nodes, ends, steps = {b"": 0}, [-1], {}
        for text, i in id_of.items():
            for k in range(len(text)):
                at, to = text[:k], text[: k + 1]
                if to not in nodes:
                    nodes[to] = len(ends)
                    ends.append(-1)
                    steps[nodes[at] << 8 | text[k]] = nodes[to]
            ends[nodes[text]] = i
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        self.step = IntMap(keys, np.fromiter(steps.values(), np.int64, len(steps)), -1)
        self.ends = np.array(ends, np.int32)

    def proposed(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """Greedy longest match of all pieces ``data[start:stop]`` side by side: (ids, owners), in
        the order of the pieces."""
        at, owner = starts.copy(), np.arange(len(starts))
        walk, node = at.copy(), np.zeros(len(at), np.int64)
        best, best_end = np.full(len(at), -1, np.int32), at.copy()
        found, found_owner, found_at = [], [], []
        while len(owner):
            inside = walk < stops[owner]
            to = np.full(len(owner), -1, np.int64)
            live = np.flatnonzero(inside)
            to[live] = self.step.get(node[live] << 8 | data[walk[live]])
            goes = to >= 0
            node = np.where(goes, to, 0)
            walk = walk + goes
            end = np.where(goes, self.ends[node], -1)
            best, best_end = np.where(end >= 0, end, best), np.where(end >= 0, walk, best_end)
            stuck = np.flatnonzero(~goes)
            if len(stuck):
                found.append(best[stuck])
                found_owner.append(owner[stuck])
                found_at.append(at[stuck])
                at[stuck] = walk[stuck] = best_end[stuck]
                node[stuck], best[stuck] = 0, -1
                keep = at < stops[owner]
                at, owner, walk, node = at[keep], owner[keep], walk[keep], node[keep]
                best, best_end = best[keep], best_end[keep]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(found_at), kind="stable")
        return (
            np.concatenate(found)[order].astype(np.int64),
            np.concatenate(found_owner)[order],
        )

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact merging of several pieces: the lowest rank first, the leftmost of equal ones."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for k in np.flatnonzero(sizes > SHORT_PIECE).tolist():
            out[k] = self._merged_long(pieces[k])
        short = np.flatnonzero(sizes <= SHORT_PIECE)
        short = short[np.argsort(sizes[short], kind="stable")]
        for at in range(0, len(short), 8192):
            rows = short[at : at + 8192]
            for k, ids in zip(rows.tolist(), self._merged_short([pieces[i] for i in rows])):
                out[k] = ids
        return out

    def _merged_short(self, pieces: list[bytes]) -> list[list[int]]:
        """One row per piece; in each step every row takes its best merge."""
        n, width = len(pieces), max(1, max(map(len, pieces)))
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, n)
        cols = np.arange(width + 1)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = self.byte_ids[raw.reshape(n, width)]
        ids[cols[None, :] >= size[:, None]] = -1
        ranks = np.full((n, width + 1), NO_MERGE, np.int32)
        r, c = np.nonzero(ids[:, 1:] >= 0)
        ranks[r, c] = self.rank.get(ids[r, c] << 32 | ids[r, c + 1])
        result, rows = ids.copy(), np.arange(n)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < NO_MERGE
            if not live.all():
                result[rows[~live]] = ids[~live]
                ids, ranks, rows, at, best = ids[live], ranks[live], rows[live], at[live], best[live]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            after = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width)
            ids = np.take_along_axis(ids, after, 1)
            ids[:, width] = -1
            ids[every, at] = self.merged_id[best]
            after = np.minimum(cols[None, :] + (cols[None, :] >= at[:, None]), width)
            ranks = np.take_along_axis(ranks, after, 1)
            for left in (at - 1, at):
                ok = np.flatnonzero((left >= 0) & (ids[every, np.minimum(left + 1, width)] >= 0))
                if len(ok):
                    pair = ids[ok, left[ok]] << 32 | ids[ok, left[ok] + 1]
                    ranks[ok, left[ok]] = self.rank.get(pair)
            last = ids[every, np.minimum(at + 1, width)] < 0
            ranks[every[last], at[last]] = NO_MERGE
        return [row[:k].tolist() for row, k in zip(result, (result >= 0).sum(1).tolist())]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same by a heap of candidates, for pieces of any length."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, rank_of = len(ids), self.rank_of
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [
            (rank, i, ids[i], ids[i + 1])
            for i in range(n - 1)
            if (rank := rank_of.get(ids[i] << 32 | ids[i + 1])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i, one, two = heapq.heappop(heap)
            j = after[i]
            if ids[i] != one or j >= n or ids[j] != two:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(self.merged_id[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    rank = rank_of.get(ids[left] << 32 | ids[right])
                    if rank is not None:
                        heapq.heappush(heap, (rank, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The exact encodings of several pieces: propose, verify, merge what fails."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces) or b"\0", np.uint8)
        flat, owner = self.proposed(data, stops - sizes, stops)
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        ids = flat.tolist()
        guesses = [ids[i:j] for i, j in zip([0, *ends], ends)]
        inside = owner[1:] == owner[:-1]
        pairs = (flat[:-1] << 32 | flat[1:])[inside]
        distinct, where = np.unique(pairs, return_inverse=True)
        fits = self._fit(distinct.tolist())
        failing = np.unique(owner[1:][inside][~fits[where]]).tolist()
        for k, exact in zip(failing, self.merged([pieces[k] for k in failing])):
            guesses[k] = exact
        return guesses

    def _fit(self, pairs: list[int]) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives the pair again."""
        if len(self.compatible) > CACHED_PAIRS:
            self.compatible = {}
        new = [pair for pair in pairs if pair not in self.compatible]
        both = [(pair >> 32, pair & 0xFFFFFFFF) for pair in new]
        found = self.merged([self.bytes_of[one] + self.bytes_of[two] for one, two in both])
        self.compatible.update((p, f == [*b]) for p, f, b in zip(new, found, both))
        return np.fromiter(map(self.compatible.__getitem__, pairs), bool, len(pairs))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The tokens' bytes; what is not UTF-8 becomes the replacement character."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()

    def pieces(self, text: str) -> list[str]:
        find = (self.pattern if NOT_LATIN.search(text) else self.latin).findall
        if self.special_split is None or not any(s in text for s in self.special):
            return find(text)
        out = []
        for part in self.special_split.split(text):
            out += [part] if part in self.special else find(part)
        return out

    def learn(self, pieces: Iterable[str]) -> list[str]:
        """Puts these pieces into ``cache``; returns those that are too long to stay there."""
        if len(self.cache) > CACHED_PIECES:
            self.cache = {}
        wanted = [p for p in pieces if p not in self.cache]
        new = [p for p in wanted if p not in self.special]
        own = dict(zip(new, self.encode_pieces([p.encode() for p in new])))
        own |= {p: [self.special[p]] for p in wanted if p in self.special}
        text, raw = self.id_text.__getitem__, self.bytes_of.__getitem__
        for p, ids in own.items():
            self.cache[p] = b",".join(map(text, ids)), b"".join(map(raw, ids))
        return [p for p in wanted if len(p) > CACHED_PIECE_BYTES]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(texts: list[str], path: str) -> list[list[int]]:
    """Ids of whole texts."""
    c = codec(path)
    out = []
    for text in texts:
        pieces = c.pieces(text)
        distinct = list(dict.fromkeys(p for p in pieces if p not in c.special))
        ids = dict(zip(distinct, c.encode_pieces([p.encode() for p in distinct])))
        ids |= {s: [i] for s, i in c.special.items()}
        out.append([i for p in pieces for i in ids[p]])
    return out


def digests(texts: list[str], path: str) -> tuple[list[int], list[str], list[str]]:
    """Per text the number of ids, the digest of the ids and that of what they decode to."""
    c = codec(path)
    split = [c.pieces(text) for text in texts]
    long = c.learn(set().union(*split))
    n_tokens, ids_sha, text_sha = [], [], []
    for pieces in split:
        known = list(map(c.cache.__getitem__, pieces))
        ids = b",".join([k[0] for k in known])
        decoded = b"".join([k[1] for k in known]).decode("utf-8", "replace").encode()
        n_tokens.append(ids.count(b",") + 1 if ids else 0)
        ids_sha.append(hashlib.sha256(ids).hexdigest())
        text_sha.append(hashlib.sha256(decoded).hexdigest())
    for p in long:
        del c.cache[p]
    return n_tokens, ids_sha, text_sha


def bpe_encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids) for every row of ``docs``: the token ids of the whole text, none for NULL."""
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i, j in byte_chunks(texts):
                ids = encode_texts([t.decode() for t in texts[i:j].to_pylist()], path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(ids, pa.list_(pa.int32()))],
                    ["id", "ids"],
                )

    return map_batches(
        given, run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded``, the text of its ids; NULL and no ids give the empty text."""
    kept = encoded.drop("decoded")
    schema = kept.withColumn("decoded", F.lit("")).schema

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids or ()).decode() for ids in batch.column(ids_col).to_pylist()]
            columns = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded"])

    return map_batches(
        kept, run, schema)


def bpe_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``.

    Encodes the whole text, then decodes the ids and hashes both. NULL counts as empty; the empty
    text has no ids and the digests of nothing. ``path`` must be readable on every executor. Rows
    are independent of each other, so repeated rows and ties need no rule; other columns are not
    looked at. One pass, no shuffle: memory holds one chunk of texts and a bounded cache of pieces.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i, j in byte_chunks(texts):
                found = digests([t.decode() for t in texts[i:j].to_pylist()], path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), *map(pa.array, found)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_batches(
        given, run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", id_col)
