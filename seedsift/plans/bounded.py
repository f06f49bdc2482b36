"""Size checks before a broadcast, and what to do when the check fails.

Three tools:

* ``settle``        writes a frame to the shared folder and reads it back: lineage is cut and
                    survives the loss of executors, and Catalyst knows its real size.
* ``fetch_bounded`` brings a frame to the driver only if it has at most ``limit`` rows; ``pin``
                    keeps such rows in the plan and settles any larger frame.
* ``keyed_join``    joins a large frame to a smaller one: by default as adaptive execution
                    decides from the sizes it sees; with explicit bounds by broadcast when the
                    measured size allows it, otherwise by a shuffle join in which the hot keys are
                    split off first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_ROWS = 100_000
PINNED_ROWS = 10_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 10_000  # a key is hot when it holds more than 1/HOT_SHARE of the rows


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local default only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return "/tmp/seedsift-checkpoints"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/seedsift/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetch_bounded(df: DataFrame, limit: int = DRIVER_ROWS) -> pa.Table | None:
    """The rows, or None when there are more than ``limit`` of them."""
    rows = df.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit else None


def local_frame(spark: SparkSession, rows: pa.Table, schema: T.StructType) -> DataFrame:
    """Fetched rows as a frame; Catalyst knows its size."""
    return spark.createDataFrame(rows, schema)


def bounded_frame(df: DataFrame, limit: int = DRIVER_ROWS) -> DataFrame | None:
    """The frame rebuilt from at most ``limit`` fetched rows, or None when it is larger."""
    rows = fetch_bounded(df, limit)
    return None if rows is None else local_frame(df.sparkSession, rows, df.schema)


def pin(df: DataFrame, name: str = "pinned", limit: int = PINNED_ROWS) -> DataFrame:
    """Cuts the lineage of a frame that is read several times: a few rows are kept in the plan,
    more are written to the shared folder."""
    local = bounded_frame(df, limit)
    return settle(df, name) if local is None else local


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(16)
    for field in df.schema.fields:
        wide = isinstance(field.dataType, (T.StringType, T.BinaryType))
        size = size + (F.coalesce(F.octet_length(field.name), F.lit(0)) + 8 if wide else F.lit(8))
    return size.cast("bigint")


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of a flat frame, by one aggregate over it."""
    return df.select(F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("b")).first()["b"]


def keyed_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int | None = None,
    max_bytes: int = BROADCAST_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """``big`` joined (inner or left) to ``small``.

    Without ``max_rows`` this is a plain join: no job runs while it is built, and Spark broadcasts
    only a side whose size it has measured. ``max_rows=0`` is for keys that may be hot.
    """
    if how not in ("inner", "left"):
        raise ValueError("keyed_join does inner and left joins")
    if max_rows is None:
        return big.join(small, list(on), how)
    local = bounded_frame(small, max_rows) if max_rows else None
    if local is not None:
        return big.join(F.broadcast(local), list(on), how)
    small = settle(small, "join-side")
    if measured_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), list(on), how)
    return hot_split_join(big, small, on, how, hot_share)


def hot_split_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], how: str, hot_share: int = HOT_SHARE
) -> DataFrame:
    """Shuffle join in which a hot key is dealt to several tasks.

    Fewer than ``hot_share`` keys can each hold more than 1/hot_share of the rows. The rows of such
    a key get a salt, as many salts as it has shares, and what ``small`` has for it is repeated for
    each of them, fewer than twice ``hot_share`` times in all. So no shuffled key is large, and
    ``big`` goes through one join. Rows with a NULL key have no partner and are dealt evenly.
    """
    keys = list(on)
    per_key = settle(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "key-counts")
    rows = per_key.agg(F.sum("_n")).first()[0] or 0
    share = max(rows / hot_share, 1.0)
    hot = F.broadcast(
        per_key.dropna(subset=keys)
        .filter(F.col("_n") > share)
        .select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_salts"))
    )
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    salts = F.when(missing, F.lit(hot_share)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = big.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")
    )
    right = small.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], how).drop("_salt")


def side_by_side(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Runs jobs that do not need each other at the same time, so that one fills the cores that
    another leaves idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


def in_list(column: str, values: Sequence, spark: SparkSession) -> Column:
    """``column IN values`` in a form that prunes Parquet pages value by value.

    Above a threshold Spark pushes only the range between the smallest and the largest value, so
    the list is repeated as ORed short lists. The long list comes first and decides for each row
    by one hash lookup.
    """
    step = max(1, int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold", "10")))
    values = sorted(values)
    if not values:
        return F.lit(False)
    if all(isinstance(value, int) for value in values):
        # One expression instead of a call per number.
        lists = [", ".join(map(str, values[i : i + step])) for i in range(0, len(values), step)]
        tests = [f"{column} IN ({one})" for one in (", ".join(lists), *lists)]
        return F.expr(tests[0]) & F.expr(" OR ".join(tests[1:]))
    literals = [F.lit(value) for value in values]
    chunks = [literals[i : i + step] for i in range(0, len(literals), step)]
    return F.col(column).isin(literals) & reduce(or_, [F.col(column).isin(c) for c in chunks])
