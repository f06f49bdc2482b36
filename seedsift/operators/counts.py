"""Token counts of labelled documents, the input of learning.

The three counting functions return one row per (klass, term) that occurs in a document of the class:
``p`` its occurrences there, ``n`` its occurrences in the other training documents (0 when
there are none), ``class_docs`` and ``all_docs`` the document counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedsift.functions.text import long_enough, space_tokens
from seedsift.plans.bounded import keyed_join, settle
from seedsift.sources.index import Index


def class_sizes(labels: DataFrame) -> DataFrame:
    """(klass, class_docs), one label row per document and class."""
    return labels.groupBy("klass").agg(F.count(F.lit(1)).alias("class_docs"))


def with_total(sizes: DataFrame) -> DataFrame:
    """Adds ``all_docs``, the sum of the class sizes, as a scalar subquery."""
    total = sizes.agg(F.sum("class_docs").alias("all_docs"))
    return sizes.withColumn("all_docs", total.scalar())


def count_terms(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "lemmas",
) -> DataFrame:
    """Positive and negative counts of a set of classes, each class against all the others.

    The negatives of a class are all occurrences minus its own, so every token is counted once
    for each class of its document and never once for each class there is.
    """
    labels = labels.select("klass", "doc_id").dropDuplicates()
    by_class = docs.select("doc_id", text_col).join(labels, "doc_id")
    return _against_the_others(_count_by_class(by_class, text_col), labels)


def count_indexed_terms(index: Index, labels: DataFrame, text_col: str = "lemmas") -> DataFrame:
    """The same from an index: only what it holds of the labelled documents is read, from the
    forward index or, for another field, from the stored documents."""
    labels = settle(labels.select("klass", "doc_id").dropDuplicates(), "counted-labels")
    if text_col != "lemmas":
        return count_terms(index.documents(labels), labels, text_col)
    by_class = index.term_counts(labels).join(labels, "doc_id")
    counted = by_class.groupBy("klass", "term").agg(F.sum("tf").alias("p"))
    return _against_the_others(counted, labels)


def _against_the_others(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """Negatives by subtraction, and the sizes of the classes, from (klass, term, p)."""
    every = F.sum("p").over(Window.partitionBy("term"))  # at most one row a class
    counted = counted.withColumn("n", every - F.col("p"))
    return keyed_join(counted, with_total(class_sizes(labels)), ["klass"])


def count_terms_one_vs_rest(training: DataFrame, text_col: str = "lemmas") -> DataFrame:
    """Counts for every class at once, each against all other training documents.

    ``training`` holds (doc_id, text, klasses) with the array of the classes of a document. A
    document also counts for a NULL class that stands for the whole training set, so one pass
    over the text serves all classes and needs no join.
    """
    anything = F.array(F.lit(None).cast("string"))
    by_class = training.select(
        "doc_id", text_col, F.explode(F.concat("klasses", anything)).alias("klass")
    )
    counted = _count_by_class(by_class, text_col)
    every = F.max(F.when(F.col("klass").isNull(), F.col("p"))).over(Window.partitionBy("term"))
    counted = counted.withColumn("n", every - F.col("p")).filter(F.col("klass").isNotNull())
    sizes = class_sizes(by_class)
    everything = sizes.filter(F.col("klass").isNull()).select("class_docs")
    sizes = sizes.filter(F.col("klass").isNotNull()).withColumn("all_docs", everything.scalar())
    return keyed_join(counted, sizes, ["klass"])


def count_terms_by_problem(
    docs: DataFrame, labelled: DataFrame, text_col: str = "lemmas"
) -> DataFrame:
    """Counts of independent two-class problems with a training set each.

    ``labelled`` holds (klass, doc_id, gold): the documents labelled for a class and whether
    they belong to it.
    """
    tokens = docs.select("doc_id", text_col).join(labelled, "doc_id")
    counted = (
        tokens.select("klass", "gold", F.explode(space_tokens(F.col(text_col))).alias("term"))
        .filter(long_enough(F.col("term")))
        .groupBy("klass", "term")
        .agg(F.count_if("gold").alias("p"), F.count_if(~F.col("gold")).alias("n"))
        .filter(F.col("p") > 0)
    )
    sizes = labelled.groupBy("klass").agg(
        F.count_if("gold").alias("class_docs"), F.count(F.lit(1)).alias("all_docs")
    )
    return keyed_join(counted, sizes, ["klass"])


def _count_by_class(by_class: DataFrame, text_col: str) -> DataFrame:
    """(klass, term, p) from rows (klass, doc_id, text)."""
    return (
        by_class.select("klass", F.explode(space_tokens(F.col(text_col))).alias("term"))
        .filter(long_enough(F.col("term")))
        .groupBy("klass", "term")
        .agg(F.count(F.lit(1)).alias("p"))
    )
