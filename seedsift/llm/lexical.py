"""Ranked lexical search by one Aho-Corasick scan of the documents, without a document index.

All terms of a block of items make one automaton, which goes to every task. Each term stands in it
between two guards, and so does each term of a text, so the automaton finds whole terms only and
its hits are the term frequencies. The scan keeps per document its length and its hits; document
frequencies and the mean length are counted from these, and a second pass over the hits alone maps
terms to items, adds up the scores and keeps the best documents of each item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedsift.llm.common import map_batches, settle, text_bytes
from seedsift.plans.prefix import prefix_sums

BEST = 20
BLOCK_TERMS = 100_000  # terms, with repeats, of the items that one automaton holds
PIECE_BYTES = 1 << 20  # of a text that is scanned at once
LONG_TERM = 256  # bytes; a longer term stands in the automaton as its digest
CELLS = 1 << 21  # documents times items that are scored at once
FULL = 1 << 18  # candidates that are held before they are cut to the best

GUARD = b"\0"
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0
    for c in range(256)
)
_LONG = re.compile(rb"[^\0]{%d,}" % (LONG_TERM + 1))
_second = itemgetter(1)


def _digest(term: bytes) -> bytes:
    """What stands for a long term; the first byte is in no term."""
    return b"\1" + sha256(term).hexdigest().encode()


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[tuple[bytes, int]]:
    """The text with a guard for each character outside of terms, cut between terms, and the number
    of terms of each piece."""
    at = 0
    while at < len(text):
        piece = text[at : at + size].translate(_LOWER)
        at += len(piece)
        while at < len(text) and piece[-1]:  # the last term goes on
            more = text[at : at + size].translate(_LOWER)
            end = more.find(GUARD) + 1 or len(more)
            piece += more[:end]
            at += end
        inside = np.frombuffer(GUARD + piece + GUARD, np.uint8) != 0
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        if not len(starts):
            continue
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        if (ends - starts).max() > LONG_TERM:
            piece = _LONG.sub(lambda m: _digest(m[0]), piece)
        yield GUARD + piece + GUARD, len(starts)


def terms_of(text: bytes) -> list[bytes]:
    """The terms in their order, long ones as digests."""
    return [t for piece, _ in pieces(text) for t in piece.split(GUARD) if t]


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds each of the terms between guards; its output is the place in the list."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word((GUARD + term + GUARD).decode("latin-1"), i)
    found.make_automaton()
    return found


def scan(text: bytes, terms: ahocorasick.Automaton | None) -> tuple[int, Counter]:
    """The number of terms of a text, and how often it holds each term of the automaton."""
    n, hits = 0, Counter()
    for piece, count in pieces(text):
        n += count
        if terms is not None:
            hits.update(map(_second, terms.iter(piece.decode("latin-1"))))
    return n, hits


def _hits(docs: DataFrame, shared) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term."""

    def run(batches):
        words = shared.value
        finder = automaton(words) if words else None
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            found = [scan(texts[i].as_py(), finder) for i in range(len(texts))]
            columns = [
                batch.column("id"),
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([list(h) for _, h in found], pa.list_(pa.int32())),
                pa.array([list(h.values()) for _, h in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "tfs"]).filter(
                pa.compute.greater(columns[1], 0)
            )

    return map_batches(docs, run, "id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Best:
    """The ``k`` best documents of each of some items, as they come."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held = [np.zeros((0, 4), np.int64)]  # item, score, no id, id
        self.n = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """``scores`` by document and item."""
        doc, item = np.nonzero(scores >= self.least)
        rows = np.stack([item, scores[doc, item], unnamed[doc], ids[doc]], 1)
        self.held.append(rows)
        self.n += len(rows)
        if self.n > FULL:
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate(self.held)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        rows, place = rows[place < self.k], place[place < self.k]
        last = place == self.k - 1
        self.least[rows[last, 0]] = rows[last, 1]
        self.held, self.n = [rows], len(rows)
        return rows


def term_scores(tfs: np.ndarray, n: np.ndarray, weights: np.ndarray, docs: int, length: int):
    """What each hit adds to the score of an item, in whole numbers. ``docs`` documents have
    ``length`` terms in all."""
    kinds, which = np.unique(n, return_inverse=True)
    m = np.array([75 + 25 * int(x) * docs // length for x in kinds], np.int64)[which]
    return weights * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m))


def _scored(hits: DataFrame, shared, docs: int, length: int, items: int, k: int) -> DataFrame:
    """(item, score, id): the best ``k`` of each task."""

    def run(batches):
        weights, starts, to, times = shared.value
        best = Best(items, k)
        step = max(1, CELLS // items)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = batch.num_rows
                sizes = pa.compute.list_value_length(batch.column("terms")).to_numpy()
                doc = np.repeat(np.arange(rows), sizes)
                term = batch.column("terms").flatten().to_numpy().astype(np.int64)
                tfs = batch.column("tfs").flatten().to_numpy()
                n = batch.column("n").to_numpy()[doc]
                value = term_scores(tfs, n, weights[term], docs, length)
                # From each term to its items.
                spread = starts[term + 1] - starts[term]
                first = np.cumsum(spread) - spread
                link = np.arange(int(spread.sum())) + np.repeat(starts[term] - first, spread)
                cell = np.repeat(doc, spread) * items + to[link]
                scores = np.zeros(rows * items, np.int64)
                np.add.at(scores, cell, np.repeat(value, spread) * times[link])
                ids = batch.column("id")
                best.add(
                    scores.reshape(rows, items),
                    ids.fill_null(0).to_numpy(),
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                )
        rows = best.cut()
        named = pa.array(rows[:, 3], pa.int64(), mask=rows[:, 2] == 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0]), pa.array(rows[:, 1]), named], ["item", "score", "id"]
        )

    return map_batches(hits, run, "item bigint, score bigint, id bigint")


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            found = [terms_of(texts[i].as_py()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"]
            )

    return map_batches(items, run, "item bigint, terms array<binary>")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item, rank, id, score): for each row of ``items`` its ``k`` best rows of ``docs``, scores
    above 0 only, the highest first, ties to the smaller id.

    Items are taken in blocks of at most ``block_terms`` terms (or one item that alone has more):
    a block's terms are what is sent to all tasks, and each block is one scan of the documents.

    A NULL or empty text, and one without a term, is found by nothing and finds nothing; it does
    not count as a document. Repeated rows are rows of their own, of documents as of items. Among
    equal scores a NULL id comes last. Texts are scanned in pieces, whatever their length; a term of
    more than 256 bytes is compared by its SHA-256. Other columns are not looked at. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    numbered = settle(
        items.select(F.col(item_col).alias("name"), F.col(item_text_col).alias("text")), "items"
    ).withColumn("item", F.monotonically_increasing_id())
    terms = settle(_item_terms(numbered.select("item", "text")), "item-terms").filter(
        F.size("terms") > 0
    )
    placed = prefix_sums(
        terms.select("item", F.size("terms").alias("n")).withColumn("all", F.lit(0)),
        ["all"],
        [F.col("item")],
        {"upto": F.col("n")},
    )
    blocks = settle(
        placed.select("item", F.expr(f"(upto - 1) div {int(block_terms)}").alias("block")), "item-blocks"
    )
    out = None
    for row in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        block = terms.join(blocks.filter(F.col("block") == row["block"]), "item")
        found = _block(texts, block.select("item", "terms").toArrow(), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item bigint, score bigint, id bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(numbered.select("item", "name"), "item").select(
        F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )


def _block(texts: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """(item, score, id) of the items of one block: their best, some from each task."""
    context = texts.sparkSession.sparkContext
    numbers = block["item"].to_numpy()
    uses = Counter(
        (term, i) for i, own in enumerate(block["terms"].to_pylist()) for term in own
    )
    words = sorted({term for term, _ in uses})
    place = {term: i for i, term in enumerate(words)}
    links = sorted((place[term], i, times) for (term, i), times in uses.items())
    of, to, times = (np.array(c, np.int64) for c in zip(*links))
    starts = np.searchsorted(of, np.arange(len(words) + 1))

    hits = settle(_hits(texts, context.broadcast(words)), "lexical-hits")
    docs, length = hits.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = np.zeros(len(words), np.int64)
    counted = hits.select(F.explode("terms").alias("term")).groupBy("term").count()
    for row in counted.toLocalIterator():
        held[row["term"]] = row["count"]
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * held + 1))).astype(np.int64)
    shared = context.broadcast((weights, starts, to, times))
    scored = _scored(hits, shared, docs, length or 1, len(numbers), k)
    names = texts.sparkSession.createDataFrame(
        pa.table({"item": np.arange(len(numbers)), "number": numbers})
    )
    return scored.join(F.broadcast(names), "item").select(
        F.col("number").alias("item"), "score", "id"
    )
