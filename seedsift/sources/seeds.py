"""The seed list: one ``+id`` (member) or ``-id`` (not a member) a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER = 0
OTHER = 1


def parse_seeds(lines: DataFrame) -> DataFrame:
    """(klass, id) from lines; lines that start with anything else are skipped."""
    sign = F.substring("value", 1, 1)
    return (
        lines.filter(sign.isin("+", "-"))
        .select(
            F.when(sign == "+", F.lit(MEMBER)).otherwise(F.lit(OTHER)).alias("klass"),
            F.expr("substring(value, 2)").alias("id"),
        )
        .dropDuplicates()
    )


def read_seeds(spark: SparkSession, path) -> DataFrame:
    return parse_seeds(spark.read.text(path))
