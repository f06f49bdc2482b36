"""The given tables in the shape of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.functions.ieee import finite_or_null, number_state
from seedsift.plans.bounded import scratch_path
from seedsift.plans.prefix import ranks
from seedsift.sources.index import spread
from seedsift.sources.seeds import MEMBER, OTHER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus: the title is the first line, the tags are language and source.

    Line breaks and tabs become one space, since a tab separated corpus cannot hold them.
    """
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return documents.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.regexp_replace("text", "[\t\n\r]+", " ").alias("lemmas"),
        F.concat_ws(" ", "lang", "source").alias("tags"),
    )


def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with ids that tell the role: labelled documents train, all others test."""
    labelled = (
        table(spark, sf_dir, "labels").select("doc_id").dropDuplicates().withColumn("_l", F.lit(1))
    )
    prefix = F.when(F.col("_l").isNotNull(), F.lit("training/")).otherwise(F.lit("test/"))
    docs = corpus(spark, sf_dir)
    return docs.join(labelled, "doc_id", "left").select(
        "doc_id", F.concat(prefix, "id").alias("id"), "title", "lemmas", "tags"
    )


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(klass, doc_id): toxic documents are class 0, the other labelled ones class 1."""
    return table(spark, sf_dir, "labels").select(
        F.when(F.col("toxic") == 1, F.lit(MEMBER)).otherwise(F.lit(OTHER)).alias("klass"), "doc_id"
    )


def seed_lines(spark: SparkSession, sf_dir: str, column: str = "toxic") -> DataFrame:
    """A seed list: ``+id`` where the label is 1, ``-id`` elsewhere."""
    sign = F.when(F.col(column) == 1, F.lit("+")).otherwise(F.lit("-"))
    return table(spark, sf_dir, "labels").select(
        F.concat(sign, F.col("doc_id").cast("string")).alias("value")
    )


def corpus_file(spark: SparkSession, sf_dir: str) -> str:
    """A tab separated corpus of the whole documents; after each line a malformed one, which has
    two columns only."""
    lines = corpus(spark, sf_dir).select(
        "doc_id",
        F.posexplode(
            F.array(
                F.concat_ws("\t", "id", "title", "lemmas", "tags"), F.concat_ws("\t", "id", "tags")
            )
        ).alias("pos", "value"),
    )
    path = scratch_path(spark, "corpus-file")
    lines.orderBy("doc_id", "pos").select("value").write.text(path)
    return path


def corpus_files(spark: SparkSession, sf_dir: str) -> str:
    """One corpus file per language, of unequal sizes, in which the source is the id."""
    documents = table(spark, sf_dir, "documents")
    lines = documents.select(
        "doc_id",
        "lang",
        F.concat_ws("\t", "source", F.col("doc_id").cast("string"), F.lit("")).alias("value"),
    )
    path = scratch_path(spark, "corpus-files")
    parted = lines.repartition("lang").sortWithinPartitions("lang", "doc_id")
    parted.select("value", "lang").write.partitionBy("lang").text(path)
    return path


def six(value: Column) -> Column:
    """Six decimals, halves upwards, in arithmetic that every engine does alike."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def in_order(df: DataFrame) -> DataFrame:
    """Adds ``position``, the place of each row in a sorted frame as it comes."""
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    return ranks(placed, [], [F.col("_place")], "position").drop("_place")


def shown(df: DataFrame, *numbers: str) -> DataFrame:
    """Doubles at 6 decimals; NaN and infinities become NULL with a ``_state`` column."""
    for name in numbers:
        value = six(finite_or_null(name))
        df = df.withColumn(f"{name}_state", number_state(name)).withColumn(
            name, F.when(value == 0, F.lit(0.0)).otherwise(value)
        )
    return df


def rounded(df: DataFrame, *numbers: str) -> DataFrame:
    """Doubles that are always finite, at 6 decimals."""
    for name in numbers:
        value = six(F.col(name))
        df = df.withColumn(name, F.when(value == 0, F.lit(0.0)).otherwise(value))
    return df
