"""From ids and signs to label rows (klass, doc_id), and set operations on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.sources.index import Index
from seedsift.sources.seeds import MEMBER, OTHER

TRAINING_PREFIX = "training/"
TEST_PREFIX = "test/"


def has_prefix(id_col: str, prefix: str) -> Column:
    return F.col(id_col).startswith(prefix)


def _first_documents(docs: DataFrame | Index, wanted: DataFrame) -> DataFrame:
    if isinstance(docs, Index):
        found = docs.numbers(wanted)
    else:
        ids = wanted.select("id").dropDuplicates()
        found = docs.select("id", "doc_id").join(ids, "id", "left_semi")
    return found.groupBy("id").agg(F.min("doc_id").alias("doc_id"))


def resolve_ids(docs: DataFrame | Index, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the ``doc_id`` of each id; the first document wins when an id repeats. An
    index in files opens only the buckets of the wanted ids."""
    return wanted.join(_first_documents(docs, wanted), "id")


def unknown_ids(docs: DataFrame | Index, wanted: DataFrame) -> DataFrame:
    return wanted.join(_first_documents(docs, wanted), "id", "left_anti")


def labels_from_seeds(docs: DataFrame | Index, seeds: DataFrame) -> DataFrame:
    """Distinct (klass, doc_id) of the seeds that the corpus knows."""
    return resolve_ids(docs, seeds).select("klass", "doc_id").dropDuplicates()


def labels_from_id_sets(docs: DataFrame | Index, pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Positive ids become class 0, negative ids class 1."""
    wanted = (
        pos.select(F.lit(MEMBER).alias("klass"), "id")
        .unionByName(neg.select(F.lit(OTHER).alias("klass"), "id"))
        .dropDuplicates()
    )
    return labels_from_seeds(docs, wanted)


def complement(training: DataFrame, pos: DataFrame, key: str = "doc_id") -> DataFrame:
    """Training documents that are not positive, also those without any tag."""
    return training.join(pos.select(key), key, "left_anti")


def union_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).dropDuplicates()


def without_labelled(scores: DataFrame, labels: DataFrame) -> DataFrame:
    return scores.join(labels.select("doc_id"), "doc_id", "left_anti")


def unlabelled_training(scores: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """What may be labelled next: scored training documents without a label."""
    return without_labelled(scores.filter(has_prefix(id_col, TRAINING_PREFIX)), labels)


def with_gold_flag(scores: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    marked = gold.select(*on).dropDuplicates().withColumn("_hit", F.lit(True))
    return (
        scores.join(marked, on, "left")
        .withColumn("gold", F.col("_hit").isNotNull())
        .drop("_hit")
    )
