"""What several operators share: reading, skew-safe lookups, whole-text batches as bytes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.plans.bounded import settle

__all__ = ["HOT_KEYS", "byte_chunks", "hash_sample", "lookup", "map_batches", "read_table", "settle", "text_bytes"]

HOT_KEYS = 1000  # fewer than this many keys can each hold more than 1/HOT_KEYS of the rows
CHUNK_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once per application, as ``--py-files`` would do."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    count: str,
    total: int,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """``rows`` with the columns of ``table``, whose ``keys`` are unique, never NULL and complete.

    ``count`` tells how many of all ``total`` rows have the key. Fewer than ``hot_keys`` keys can
    hold more than ``total / hot_keys`` rows each: these take a broadcast, whose size is thus
    bounded, and all others a shuffle in which no key is large. Both frames are read twice, so
    they should be settled tables.
    """
    keys = list(keys)
    is_hot = F.col(count) > F.lit(total / hot_keys)
    hot = F.broadcast(table.filter(is_hot).drop(count))
    cold = table.filter(~is_hot).drop(count)
    return rows.join(hot, keys).unionByName(
        rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)
    )


def hash_sample(rows: DataFrame, id_col: str, k: int, seed: int) -> pa.Table:
    """About ``k`` rows on the driver, never more: those whose id's seeded hash is smallest. A
    threshold on the hash picks them where they lie, so no task sees more than its share."""
    n = rows.count()
    fraction = min(1.0, (k + 6 * k**0.5 + 10) / max(n, 1))
    draw = F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double")
    drawn = rows.withColumn("_draw", draw * F.lit(2.0**-53)).filter(F.col("_draw") <= fraction)
    found = drawn.limit(2 * k + 100).toArrow()
    order = found.sort_by([("_draw", "ascending"), (id_col, "ascending")])
    return order.slice(0, k).drop_columns(["_draw"])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as UTF-8, NULL as empty, with 64 bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single text that is longer than that."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first, n = 0, len(sizes)
    while first < n:
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + limit, side="right")), first + 1)
        yield first, last
        first = last


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")
