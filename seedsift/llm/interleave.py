"""Shards by proportional stratified interleaving, with DataFrame functions only.

Within each source the rows take a seeded shuffled order; the r-th of n gets the fraction
(r - 1/2) / n. Sorted by fraction, the sources lie interleaved in their proportions everywhere, so
cutting that order into stretches of equal length gives shards that all match the mixture.

Neither rank needs a task that holds a source. Both orders are uniform by construction, so each is
split into equal steps of its range: rows are ranked within a step, and the few step counts say
how many rows come before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.llm.common import settle

SOURCE_STEPS_LOG2 = 12  # steps of a source's order
STEPS = 1 << 14  # steps of the common order; their counts are the only broadcast
SHARDS = 24
SEED = 17


def text_size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def text_crc32(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("bigint")


def interleaved_shards(
    docs: DataFrame,
    n_shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, *carry) for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 8, a NULL text has none. A NULL source is a source of
    its own, NULL ids are shuffled by text. Shards differ by one row at most, ``slot`` counts from
    0 without gaps, and every source is spread over the shards in proportion. Rows that are
    repeated in full are interchangeable. Only the named columns of ``docs`` are read; ``carry``
    names further ones to take along. An empty table gives an empty result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        (text_size(text_col) + 8).alias("size"),
        text_crc32(text_col).alias("crc"),
        F.col(source_col).isNull().alias("_none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        F.struct(*carry).alias("_carry") if carry else F.lit(None).cast("int").alias("_carry"),
    )
    rows = rows.withColumn("_draw", F.xxhash64("id", "crc", "size", F.lit(seed)))
    step = F.shiftrightunsigned("_draw", 64 - SOURCE_STEPS_LOG2)
    rows = settle(rows.withColumn("_step", step), "shard-rows")
    source = ["_none", "_source"]

    counts = rows.groupBy(*source, "_step").agg(F.count(F.lit(1)).alias("_here"))
    before = Window.partitionBy(*source).orderBy("_step")
    counts = counts.select(
        *source,
        "_step",
        (F.sum("_here").over(before) - F.col("_here")).alias("_before"),
        F.sum("_here").over(Window.partitionBy(*source)).alias("_n"),
    )
    # The shifted draw orders the steps as unsigned numbers, the draw itself within a step.
    order = [F.col(c) for c in ("_draw", "id", "size", "crc")]
    inside = Window.partitionBy(*source, "_step").orderBy(*order)
    rank = F.col("_before") + F.row_number().over(inside)
    ranked = (
        rows.join(counts, [*source, "_step"])
        .withColumn("_part", (rank - F.lit(0.5)) / F.col("_n"))
        .withColumn("_at", F.floor(F.col("_part") * STEPS).cast("int"))
        .select("id", "size", "crc", *source, "_draw", "_carry", "_part", "_at")
    )
    ranked = settle(ranked, "shard-fractions")

    steps = ranked.groupBy("_at").agg(F.count(F.lit(1)).alias("_here"))
    total = steps.agg(F.sum("_here")).first()[0] or 0
    # At most STEPS rows, whatever the input.
    steps = steps.select(
        "_at", (F.sum("_here").over(Window.orderBy("_at")) - F.col("_here")).alias("_before")
    )
    everywhere = [F.col(c) for c in ("_part", *source, "_draw", "id", "size", "crc")]
    inside = Window.partitionBy("_at").orderBy(*everywhere)
    n, all_rows = F.lit(n_shards), F.lit(max(total, 1))
    placed = (
        ranked.join(F.broadcast(steps), "_at")
        .withColumn("_place", F.col("_before") + F.row_number().over(inside) - 1)
        .withColumn("n", n.cast("bigint"))
        .withColumn("all", all_rows.cast("bigint"))
        .withColumn("shard", F.expr("_place * n div all"))
        .withColumn("slot", F.expr("_place - (shard * all + n - 1) div n"))
    )
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        *[F.col("_carry")[name].alias(name) for name in carry],
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, **options) -> None:
    """Writes the rows as Parquet, one folder per shard, each in the order of its slots."""
    placed = interleaved_shards(docs, n_shards, **options)
    (
        placed.repartition(n_shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
