"""The tab separated corpus: ``id \\t title \\t lemmas [\\t tags]``, UTF-8, one document a line."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("id", T.StringType(), True),
        T.StructField("title", T.StringType(), True),
        T.StructField("lemmas", T.StringType(), True),
        T.StructField("tags", T.StringType(), True),
    ]
)


_NAMES = ("id", "title", "lemmas", "tags")


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Every line with ``doc_id``, a unique number that grows along each input split, but says
    nothing about the order of the splits: those are packed by size. See ``number_lines``."""
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("doc_id"),
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``line_no``, the exact 1-based number in the order of the files, and lets ``doc_id``
    follow it from 0, so that "the earlier document" means the same for any number of files.

    Lines are counted per input split, by one more pass over the files. The counts are one row a
    split, which the driver has planned anyway: they are added up there and go to all tasks, and no
    line moves.
    """
    split = ["file_path", "block_start"]
    counts = lines.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first")
    )
    rows = sorted(tuple(row) for row in counts.toLocalIterator())
    before = accumulate((n for _, _, n, _ in rows), initial=0)
    offsets = lines.sparkSession.createDataFrame(
        [(path, start, first, done) for (path, start, _, first), done in zip(rows, before)],
        "file_path string, block_start bigint, _first bigint, _before bigint",
    )
    place = F.col("_before") + F.col("doc_id") - F.col("_first")
    return lines.join(F.broadcast(offsets), split).select(
        place.alias("doc_id"),
        *[c for c in lines.columns if c != "doc_id"],
        (place + 1).alias("line_no"),
    )


def _parts() -> Column:
    return F.split("value", "\t", 4)


def _fields() -> list[Column]:
    return [F.get("_parts", F.lit(i)).alias(name) for i, name in enumerate(_NAMES)]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Documents from lines with three or four columns; further tabs stay in the tags."""
    return (
        lines.withColumn("_parts", _parts())
        .filter(F.size("_parts") >= 3)
        .select(*[c for c in lines.columns if c != "value"], *_fields())
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines with fewer than three columns, as they were read."""
    return lines.filter(F.size(_parts()) < 3).withColumnRenamed("value", "raw_line")


def sorted_out(lines: DataFrame) -> DataFrame:
    """Documents and rejected lines in one frame, told apart by ``valid`` (1 or 0): documents have
    the columns of a corpus, rejected lines ``file_path``, ``line_no`` and ``raw_line``."""
    fine = F.size("_parts") >= 3
    marked = lines.withColumn("_parts", _parts()).withColumn("valid", fine.cast("int"))
    rejected = F.col("valid") == 0
    fields = [F.when(~rejected, field).alias(name) for field, name in zip(_fields(), _NAMES)]
    return marked.select(
        "doc_id",
        *fields,
        F.when(rejected, F.col("file_path")).alias("file_path"),
        F.when(rejected, F.col("line_no")).alias("line_no"),
        F.when(rejected, F.col("value")).alias("raw_line"),
        "valid",
    )


def read_corpus(spark: SparkSession, path) -> DataFrame:
    lines = number_lines(read_lines(spark, path))
    return parse_lines(lines).select(*CORPUS_SCHEMA.fieldNames())


def corpus_from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """An in-memory corpus from (id, title, lemmas, tags) tuples, numbered in their order."""
    numbered = [(i, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, CORPUS_SCHEMA)


def usable(docs: DataFrame, text_col: str = "lemmas") -> DataFrame:
    """Documents that have the feature field."""
    return docs.filter(F.col(text_col).isNotNull())


def count_without_text(docs: DataFrame, text_col: str = "lemmas") -> DataFrame:
    return docs.agg(F.count_if(F.col(text_col).isNull()).alias("n_without_text"))
