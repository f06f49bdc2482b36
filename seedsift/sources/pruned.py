"""Tables in parts, and reads that open only what can hold the wanted keys.

A part is a folder, ``part=n``, so parts that hold none of the keys are left out when files are
listed, before one is opened. Inside a part rows are sorted by the key and pages are short; at most
``RANGES`` key ranges that cover the wanted keys go to the Parquet reader, which skips the other
pages. Both take a bounded amount of the driver whatever the number of keys: one number for each
part that is opened, and the ranges. Which rows match is decided by a join.

* ``Clustered``  rows with neighbouring keys lie together; a table of bounds leads to the parts.
* ``Bucketed``   the hash of the key tells the part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedsift.plans.bounded import in_list, settle

PAGE_ROWS = 1024
RANGES = 64
WIDE_RANGES = 12  # a filter of more ranges than this costs more than it saves


def write_parts(df: DataFrame, path: str, part: str, order: Sequence[str]) -> None:
    """Writes a frame that has the column ``part`` into its folders, sorted by ``order`` in each."""
    rows = df.sortWithinPartitions(part, *order).write.mode("overwrite")
    rows.option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy(part).parquet(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType, part: str) -> DataFrame:
    """The table, also one without a row, which has no file to tell its columns."""
    kept = [f for f in schema.fields if f.name != part]
    whole = T.StructType([*kept, T.StructField(part, T.IntegerType())])
    return spark.read.schema(whole).parquet(path)


def in_ranges(key: str, ranges: Sequence[tuple], spark: SparkSession) -> Column:
    """A filter that the Parquet reader understands. Ranges of one key each are a list of keys; of
    wider ones neighbours are joined until few are left."""
    if all(lo == hi for lo, hi in ranges):
        return in_list(key, [lo for lo, _ in ranges], spark)
    step = -(-len(ranges) // WIDE_RANGES)
    joined = [(ranges[i][0], ranges[min(i + step, len(ranges)) - 1][1]) for i in range(0, len(ranges), step)]
    return reduce(or_, [F.col(key).between(F.lit(lo), F.lit(hi)) for lo, hi in joined])


@dataclass(frozen=True)
class Reach:
    """What has to be opened: parts, and key ranges within them."""

    parts: list[int]
    ranges: list[tuple]

    def of(self, rows: DataFrame, part: str, key: str) -> DataFrame:
        near = in_ranges(key, self.ranges, rows.sparkSession)
        return rows.filter(F.col(part).isin(self.parts)).filter(near)


def reach(keys: DataFrame, part: str, key: str, ranges: int = RANGES) -> Reach:
    """From wanted keys and the parts they may lie in. Of up to ``ranges`` keys each is a range of
    its own; more keys share ranges with their neighbours. ``keys`` is read twice."""
    dealt = keys.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id())
    found = (
        dealt.groupBy("_range")
        .agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.collect_set(part).alias("parts"))
        .collect()
    )
    return Reach(
        sorted({p for row in found for p in row["parts"]}),
        sorted((row["lo"], row["hi"]) for row in found if row["lo"] is not None),
    )


@dataclass(frozen=True)
class Clustered:
    """(part, key, ...) and ``bounds`` (part, lo, hi), one row a part."""

    rows: DataFrame
    bounds: DataFrame
    key: str = "doc_id"

    @staticmethod
    def write(df: DataFrame, path: str, order: Sequence[str], key: str = "doc_id") -> Clustered:
        """``df`` has the column ``part``; what it says of a row's place should follow the key."""
        spark = df.sparkSession
        write_parts(df, f"{path}/rows", "part", order)
        rows = read_parts(spark, f"{path}/rows", df.schema, "part")
        rows.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/bounds")
        return Clustered.open(spark, path, rows.schema, key)

    @staticmethod
    def open(spark: SparkSession, path: str, schema: T.StructType, key: str = "doc_id") -> Clustered:
        return Clustered(
            read_parts(spark, f"{path}/rows", schema, "part"),
            spark.read.parquet(f"{path}/bounds"),
            key,
        )

    @cached_property
    def _width(self) -> int:
        """Of the steps in which keys meet the bounds: about as many as there are parts."""
        lo, hi, n = self.bounds.agg(F.min("lo"), F.max("hi"), F.count(F.lit(1))).first()
        return 1 if not n or lo is None else max(1, (hi - lo) // n + 1)

    def reach(self, keys: DataFrame) -> Reach:
        """What may hold the keys, distinct numbers in a settled frame."""
        step = f"div {self._width}"
        bounds = self.bounds.selectExpr(
            "part", "lo", "hi", f"explode(sequence(lo {step}, hi {step})) AS _step"
        )
        placed = keys.select(self.key).withColumn("_step", F.expr(f"{self.key} {step}"))
        met = placed.join(bounds, "_step").filter(F.col(self.key).between(F.col("lo"), F.col("hi")))
        return reach(met.select(self.key, "part"), "part", self.key)

    def select(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, any number of them."""
        wanted = settle(keys.select(self.key).dropna().distinct(), "wanted")
        near = self.reach(wanted).of(self.rows, "part", self.key)
        return near.drop("part").join(wanted, self.key, "left_semi")


@dataclass(frozen=True)
class Bucketed:
    """(bucket, key, ...) in ``n`` buckets."""

    rows: DataFrame
    key: str
    n: int

    @staticmethod
    def bucket(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    @staticmethod
    def write(df: DataFrame, path: str, key: str, n: int, order: Sequence[str] = ()) -> Bucketed:
        spark = df.sparkSession
        n = max(1, n)
        rows = df.filter(F.col(key).isNotNull()).withColumn("bucket", Bucketed.bucket(key, n))
        write_parts(rows.repartition("bucket"), f"{path}/rows", "bucket", [key, *order])
        spark.range(1).select(F.lit(n).alias("n")).write.mode("overwrite").parquet(f"{path}/buckets")
        return Bucketed(read_parts(spark, f"{path}/rows", rows.schema, "bucket"), key, n)

    @staticmethod
    def open(spark: SparkSession, path: str, schema: T.StructType, key: str) -> Bucketed:
        n = spark.read.parquet(f"{path}/buckets").first()["n"]
        return Bucketed(read_parts(spark, f"{path}/rows", schema, "bucket"), key, n)

    def reach(self, keys: DataFrame) -> Reach:
        placed = keys.select(self.key).withColumn("bucket", self.bucket(self.key, self.n))
        return reach(placed, "bucket", self.key)

    def select(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, any number of them, distinct ones in a settled frame."""
        near = self.reach(keys).of(self.rows, "bucket", self.key)
        return near.drop("bucket").join(keys.select(self.key), self.key, "left_semi")
