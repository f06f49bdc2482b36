"""Text sinks: search results and evaluation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVAL_COLUMNS = ("klass", "n_train", "n_pos", "n_neg", "p", "r", "f1")


def _write_lines(df: DataFrame, columns, separator: str, path: str) -> None:
    line = F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """``score \\t id \\t title \\t snippet``, in the order of the frame."""
    _write_lines(results, ("score", "id", "title", "snippet"), "\t", path)


def write_evaluation(evaluation: DataFrame, path: str) -> None:
    """``tag n_train n_pos n_neg p r f1``, separated by spaces."""
    _write_lines(evaluation, EVAL_COLUMNS, " ", path)
