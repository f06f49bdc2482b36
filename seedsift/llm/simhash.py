"""Near duplicates by SimHash, found through pivot distance tables.

A document's fingerprint is the bitwise majority of its shingles' hashes. Every distinct
fingerprint gets its Hamming distances to fixed reference fingerprints, the pivots. By the triangle
inequality two fingerprints within ``max_bits`` differ by at most that much in each coordinate of
this table, so a pair whose largest coordinate difference is greater is discarded, and only the
survivors are verified bit by bit.

Which pairs meet at all is decided without loss: split into ``max_bits + 3`` blocks, close
fingerprints agree in some three whole blocks, and each choice of three blocks is one join key.
Only distinct fingerprints are joined, so a group of copies is one row, however large, and no
fingerprint has more than the few partners that lie within ``max_bits``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import byte_chunks, hex16, lookup, map_batches, settle, text_bytes
from seedsift.llm.graph import contract
from seedsift.llm.shingles import grouped

SHINGLE_WORDS = 3
MAX_BITS = 2
PIVOTS = 16
SEED = 42
CHUNK_BYTES = 1 << 20  # texts whose shingles are hashed at once


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """One unsigned 64 bit fingerprint per text; 0 for a text without a word. Votes are counted
    piece by piece, so a long text takes no more memory than a short one."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    for of, hashed, counts in grouped(texts, words, seed, CHUNK_BYTES):
        bits = np.unpackbits(hashed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int64)
        np.add.at(ones, of, votes)
        np.add.at(total, of, counts)
    majority = np.packbits(2 * ones > total[:, None], axis=1)
    return majority.view(">u8").ravel().astype(np.uint64)


def fingerprint_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS
) -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i, j in byte_chunks(texts, CHUNK_BYTES):
                found = fingerprints(texts[i:j].to_pylist(), words).view(np.int64)
                ids = batch.column("id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found)], ["id", "fp"])

    return map_batches(
        given, run, "id bigint, fp bigint")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed longs, from a fixed rule."""
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}")))) for i in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(max_bits: int) -> list[int]:
    """The choices of three blocks out of ``max_bits + 3``, as bit masks."""
    blocks = max_bits + 3
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(parts, 3)]


def close_pairs(nodes: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS) -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct ``fp`` that differ in at most ``max_bits``."""
    masks = block_masks(max_bits)
    references = pivots(n_pivots)

    def distance(one: Column, other: Column) -> Column:
        return F.bit_count(one.bitwiseXOR(other))

    fp = F.col("fp")
    table = F.array(*[distance(fp, F.lit(p)).cast("tinyint") for p in references])
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("key"))
            for i, mask in enumerate(masks)
        ]
    )
    keyed = nodes.select("fp", table.alias("pivot"), F.explode(keys).alias("k")).select(
        "fp", "pivot", "k.choice", "k.key"
    )
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = [F.abs(F.col("a.pivot")[i] - F.col("b.pivot")[i]) for i in range(n_pivots)]
    # A pair that agrees in several choices is emitted by the first of them only.
    differing = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    repeated = F.lit(False)
    for i, mask in enumerate(masks[:-1]):
        same = differing.bitwiseAND(F.lit(mask)) == 0
        repeated = repeated | ((F.col("a.choice") > i) & same)
    return a.join(
        b,
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.greatest(*apart) <= max_bits)
        & (F.bit_count(differing) <= max_bits)
        & ~repeated,
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(id, fingerprint, component_id, component_size) for every row of ``docs``.

    Rows whose fingerprints differ in at most ``max_bits`` bits are linked; ``component_id`` is the
    smallest id that can be reached. A NULL or empty text has fingerprint zero and links like any
    other. A NULL id is returned but names a component only where there is no other id, as NULL.
    Repeated rows each get a row. Other columns of ``docs`` are not looked at. An empty table gives
    an empty result.
    """
    rows = settle(fingerprint_rows(docs, id_col, text_col, words), "simhash-rows")
    nodes = settle(
        rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")),
        "simhash-nodes",
    )
    total = nodes.agg(F.sum("n")).first()[0] or 0
    roots = contract(close_pairs(nodes, max_bits))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = linked.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("n").alias("component_size")
    )
    table = settle(
        linked.join(named, "root").select("fp", "n", "component_id", "component_size"),
        "simhash-components",
    )
    return lookup(rows, table, ["fp"], "n", total).select(
        F.col("id").alias(id_col),
        hex16(F.col("fp")).alias("fingerprint"),
        "component_id",
        "component_size",
    )
