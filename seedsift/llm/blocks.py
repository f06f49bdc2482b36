"""Sums of large count arrays over all tasks of a job, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from seedsift.llm.common import map_batches

BLOCK = 1 << 14  # numbers in a block
FAN_IN = 64  # tasks whose blocks are added up first
SCHEMA = "lane bigint, block bigint, counts binary"


def _batch(lane: int, blocks: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    packed = [pa.compress(c.astype("<i8").tobytes(), "zstd", asbytes=True) for _, c in blocks]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lane] * len(blocks), pa.int64()),
            pa.array([b for b, _ in blocks], pa.int64()),
            pa.array(packed, pa.binary()),
        ],
        ["lane", "block", "counts"],
    )


def unpack(packed: bytes, size: int = BLOCK) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 8 * size, "zstd", asbytes=True), "<i8")


def summed(
    df: DataFrame,
    size: int,
    add: Callable[[np.ndarray, Iterator[pa.RecordBatch]], None],
) -> DataFrame:
    """(block, counts): the sum over all tasks of the integer arrays of ``size`` numbers that
    ``add`` fills from a task's batches. Each task sends its non-zero blocks once, compressed; they
    are added in two levels, so no task reads a block from more than a bounded share of all tasks.
    ``size`` is a multiple of ``BLOCK``."""

    def fill(batches):
        total = np.zeros(size, np.int64)
        add(total, batches)
        parts = total.reshape(-1, BLOCK)
        full = np.flatnonzero(parts.any(1))
        lane = TaskContext.get().partitionId() // FAN_IN
        for i in range(0, len(full), 64):
            yield _batch(lane, [(int(b), parts[b]) for b in full[i : i + 64]])

    def merge(batches):
        key, total = None, None
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("lane", "block", "counts"))
            for lane, block, packed in zip(*columns):
                if key != (lane, block):
                    if key is not None:
                        yield _batch(key[0], [(key[1], total)])
                    key, total = (lane, block), np.zeros(BLOCK, np.int64)
                total = total + unpack(packed)
        if key is not None:
            yield _batch(key[0], [(key[1], total)])

    def level(rows: DataFrame) -> DataFrame:
        return map_batches(
            rows.repartition("lane", "block").sortWithinPartitions("lane", "block"), merge, SCHEMA
        )

    first = level(map_batches(df, fill, SCHEMA))
    return level(first.selectExpr("CAST(0 AS BIGINT) AS lane", "block", "counts")).drop("lane")


def collected(blocks: DataFrame, size: int, dtype: type = np.float32) -> np.ndarray:
    """The whole array on the driver, as floats; its size is a parameter, whatever the data."""
    total = np.zeros(size, dtype)
    for row in blocks.toLocalIterator():
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = unpack(bytes(row["counts"]))
    return total
