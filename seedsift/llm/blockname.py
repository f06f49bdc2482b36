"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of a fixed size. Distinct blocks are sorted and
named by integers; then adjacent names are paired and the distinct pairs named, again and again,
until each document has one name. Names stand for contents, never for hashes of them, so two
documents of equally many blocks have one name exactly when they are equal.

The first names need the only shuffle of text. Before it, a block that repeats within a batch of
documents is replaced by a reference to its first place there, so a block of a third of all
documents goes once per batch. Every later round moves integers, and only for documents of several
blocks; the most frequent pairs and the largest groups of copies are looked up by broadcast.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.llm.common import byte_chunks, lookup, map_batches, settle, text_bytes

WHITE_SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 16 << 10
BUCKETS = 1 << 20


def _cut(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows of documents (``refs`` filled) and rows of blocks (``block`` filled)."""

    def run(batches):
        task, rows, places = TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            ids, given = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            for i, j in byte_chunks(texts):
                first: dict[bytes, int] = {}
                out = {name: [] for name in ("row", "id", "n_chars", "text_sha256", "refs")}
                for k, text in enumerate(texts[i:j].to_pylist(), i):
                    plain = text.translate(None, WHITE_SPACE)
                    refs = []
                    for at in range(0, max(len(plain), 1), block_bytes):
                        block = plain[at : at + block_bytes]
                        refs.append(first.setdefault(block, task + places + len(first)))
                    out["row"].append(task + rows if given[k] is None else given[k])
                    out["id"].append(ids[k])
                    out["n_chars"].append(chars[k])
                    out["text_sha256"].append(hashlib.sha256(plain).hexdigest())
                    out["refs"].append(refs)
                    rows += 1
                places += len(first)
                n = len(out["row"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["row"], pa.int64()),
                        pa.array(out["id"], pa.int64()),
                        pa.array(out["n_chars"], pa.int64()),
                        pa.array(out["text_sha256"], pa.string()),
                        pa.array(out["refs"], pa.list_(pa.int64())),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names,
                )
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.string()),
                        pa.nulls(n, pa.list_(pa.int64())),
                        pa.array(first.values(), pa.int64()),
                        pa.array(first.keys(), pa.binary()),
                    ],
                    names,
                )

    names = ["row", "id", "n_chars", "text_sha256", "refs", "ref", "block"]
    return map_batches(
        docs, run,
        "row bigint, id bigint, n_chars bigint, text_sha256 string, refs array<bigint>, "
        "ref bigint, block binary",
    )


def _names(bucket: Column, *order: Column) -> Column:
    """Integer names: rows of one bucket are equal in ``order`` exactly when their names are."""
    rank = F.dense_rank().over(Window.partitionBy(bucket).orderBy(*order))
    return F.shiftleft(bucket, 40) + rank.cast("bigint")


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("bigint")


def block_identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row, id, n_chars, text_sha256, n_blocks, name) for every row of ``docs``; ``row`` is unique,
    and two rows have equal texts exactly when ``n_blocks`` and ``name`` are equal."""
    given = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).alias("text"),
        (F.col(row_col) if row_col else F.lit(None)).cast("bigint").alias("row"),
    )
    # Rows of documents have no block; a spread of their own keeps them out of the blocks' buckets.
    cut = _cut(given, block_bytes).withColumn(
        "bucket",
        F.when(F.col("ref").isNotNull(), _bucket("block")).otherwise(-1 - _bucket("row")),
    )
    named = settle(
        cut.withColumn("name", _names(F.col("bucket"), F.col("block"))).drop("block", "bucket"),
        "block-names",
    )
    rows = named.filter("ref IS NULL").drop("ref", "name")
    rows = rows.withColumn("n_blocks", F.size("refs").cast("bigint"))
    blocks = named.filter("ref IS NOT NULL").select("ref", "name")
    # A reference is used within one batch only, so no reference is hot.
    parts = rows.select("row", "n_blocks", F.posexplode("refs").alias("pos", "ref"))
    parts = settle(parts.join(blocks, "ref").select("row", "n_blocks", "pos", "name"), "parts")
    longest = parts.agg(F.max("n_blocks")).first()[0] or 0
    done = parts.filter("n_blocks = 1").select("row", "name")
    width = 1
    while width < longest:
        left = F.when(F.col("pos") % 2 == 0, F.col("name"))
        right = F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = settle(
            parts.filter(F.col("n_blocks") > width)
            .groupBy("row", "n_blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(left).alias("l"), F.coalesce(F.max(right), F.lit(-1)).alias("r")),
            "pairs",
        )
        distinct = pairs.groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))
        names = settle(
            distinct.withColumn("bucket", _bucket("l", "r"))
            .withColumn("name", _names(F.col("bucket"), F.col("l"), F.col("r")))
            .select("l", "r", "n", "name"),
            "pair-names",
        )
        total = names.agg(F.sum("n")).first()[0] or 0
        parts = lookup(pairs, names, ["l", "r"], "n", total).select(
            "row", "n_blocks", "pos", "name"
        )
        parts = settle(parts, "parts")
        width *= 2
        done = done.union(parts.filter(F.col("n_blocks") <= width).select("row", "name"))
    return rows.drop("refs").join(done, "row")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row, id, keep_row, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when they are identical without white space; NULL counts as empty. Of equal
    texts the row with the most code points in its original text stays, then the smallest id (NULL
    last), then the smallest ``row_col`` (by default the place in the input), so exactly one of
    several repeated rows stays. Other columns of ``docs`` are not looked at. An empty table gives
    an empty result.
    """
    rows = settle(block_identities(docs, id_col, text_col, row_col, block_bytes), "identities")
    order = F.struct(
        -F.col("n_chars"), F.col("id").isNull(), F.col("id"), F.col("row").alias("keep_row")
    )
    groups = settle(
        rows.groupBy("n_blocks", "name")
        .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
        .select(
            "n_blocks",
            "name",
            "n",
            F.col("n").alias("group_size"),
            F.col("best.id").alias("keep_id"),
            F.col("best.keep_row").alias("keep_row"),
        ),
        "copies",
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    return lookup(rows, groups, ["n_blocks", "name"], "n", total).select(
        "row",
        F.col("id").alias(id_col),
        "keep_row",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )
