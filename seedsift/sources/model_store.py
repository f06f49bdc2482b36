"""Saved models and their listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_model(model: DataFrame, priors: DataFrame, path: str) -> None:
    """The model in rank order per class, so that a read of the best features prunes row groups."""
    order = [name for name in ("klass", "rank", "term") if name in model.columns]
    model.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(
        f"{path}/terms"
    )
    priors.write.mode("overwrite").parquet(f"{path}/priors")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/priors")


def model_listing(ranked: DataFrame) -> DataFrame:
    """The model as text lines: the features of each class by rank, then ``term/weight`` pairs.

    One row a line with its place (part, klass, rank); nothing is gathered per class.
    """
    features = ranked.select(F.lit(0).alias("part"), "klass", "rank", F.col("term").alias("line"))
    weights = ranked.select(
        F.lit(1).alias("part"),
        "klass",
        "rank",
        F.concat_ws("/", "term", F.col("log_likelihood").cast("string")).alias("line"),
    )
    return features.unionByName(weights)


def write_listing(ranked: DataFrame, path: str) -> None:
    listing = model_listing(ranked).orderBy("part", "klass", "rank")
    listing.select(F.concat_ws(": ", F.col("klass").cast("string"), "line").alias("value")).write.mode(
        "overwrite"
    ).text(path)


def feature_trace(ranked: DataFrame, klass, n: int) -> DataFrame:
    """(iteration, feature, log_likelihood) of the steps a search takes."""
    return ranked.filter((F.col("klass") == klass) & (F.col("rank") <= n)).select(
        (F.col("rank") - 1).alias("iteration"), F.col("term").alias("feature"), "log_likelihood"
    )
