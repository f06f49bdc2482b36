"""Raw documents to training data: each stage is one operator over all that the one before kept.

A stage sees the documents that are left, and labels of any document. Every stage takes NULLs in any
column, empty and very long texts, repeated rows, columns besides those of ``documents`` and empty
tables; a NULL text counts as empty. Rows are told apart by their place, never by ``doc_id``, so
repeated and NULL ids stay rows of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.llm.blockname import exact_dedup
from seedsift.llm.bpe import bpe_digests
from seedsift.llm.catalogue import vocabulary_path
from seedsift.llm.classifier import keep_quality, train_quality
from seedsift.llm.common import read_table, settle
from seedsift.llm.mixing import mixed_documents
from seedsift.llm.simhash import simhash_components

#: No SQL says what the classifier, the fingerprints and the merges say.
ORACLE_SQL = None

def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows numbered by their place in the stage's input, a settled table, in a column that is new."""
    name = "_pipeline_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with all their columns.

    It is trained on the labels of documents that are there; without any, or with labels of one
    kind only, it has nothing to learn from and its prior decides. Empty and NULL texts are scored
    like any other, equal texts alike, so repeated rows stay or go together.
    """
    return keep_quality(docs, train_quality(docs, read_table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the one with most characters stays, of equal
    ones the first row. All empty, blank and NULL texts are equal, so one row of them stays."""
    rows, place = _numbered(docs)
    kept = exact_dedup(rows, row_col=place).filter("kept").select(F.col("row").alias(place))
    return rows.join(kept, place, "left_semi").drop(place)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first row stays. Texts without a word have the
    fingerprint zero and are a group like any other."""
    rows, place = _numbered(docs)
    kept = simhash_components(rows, id_col=place).filter(f"{place} = component_id").select(place)
    return rows.join(kept, place, "left_semi").drop(place)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target says, up to twice; copies are equal rows. A
    NULL source is a source. Texts without a word add nothing to a source's size."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded documents, one row for each that came in; an empty or
    NULL text has no tokens."""
    return bpe_digests(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again. Without documents
    there are no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


pipeline = run
