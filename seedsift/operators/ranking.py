"""Result lists: best documents, full rankings and the next example to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = 20


def top_documents(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best scores; among equal ones the earlier document stays."""
    return scores.orderBy(F.col("score").desc(), "doc_id").limit(k)


def result_order(worst_first: bool = False) -> list[Column]:
    """Best first; the reference prints its bounded heap worst first."""
    if worst_first:
        return [F.col("score").asc(), F.col("doc_id").desc()]
    return [F.col("score").desc(), F.col("doc_id").asc()]


def full_ranking(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("score").desc(), "id")


def random_key(seed: int, id_col: str = "id") -> Column:
    """A repeatable pseudo-random order of ids."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def example_key(strategy: str = "top", seed: int = 0) -> Column:
    """What sorts first is labelled first. ``top``: highest score, ``uncertain``: closest to
    zero, ``random``: any."""
    keys = {
        "top": lambda: -F.col("score"),
        "uncertain": lambda: F.abs("score"),
        "random": lambda: random_key(seed),
    }
    return keys[strategy]()


def next_example(candidates: DataFrame, strategy: str = "top", seed: int = 0) -> DataFrame:
    """The one unlabelled training document (id, score) to label next."""
    return candidates.orderBy(example_key(strategy, seed), "id").limit(1)
