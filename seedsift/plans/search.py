"""Jobs: index a corpus, and search it by example."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedsift.functions.text import snippet
from seedsift.operators.counts import count_indexed_terms
from seedsift.operators.labels import labels_from_seeds, without_labelled
from seedsift.operators.learn import LearnOptions, score_counts, top_features
from seedsift.operators.ranking import TOP_K, result_order, top_documents
from seedsift.operators.scoring import FEATURES_SEARCH, posting_scores
from seedsift.plans.bounded import settle
from seedsift.sources.corpus import number_lines, read_lines, sorted_out
from seedsift.sources.index import Index, index_stored, store_documents
from seedsift.sources.seeds import MEMBER


def index_corpus(
    spark: SparkSession,
    corpus_path,
    index_path: str,
    max_tokens: int | None = None,
    max_word: int | None = None,
) -> tuple[Index, DataFrame]:
    """Indexes a corpus of one or several files, in the order of the files; also returns the
    rejected lines with their numbers. The files are read twice: to count lines, and to write
    documents and rejected lines, which stay in the order and the partitions they are read in."""
    rows = sorted_out(number_lines(read_lines(spark, corpus_path)))
    documents, rejects = store_documents(rows, index_path)
    index = index_stored(documents, index_path, max_tokens, max_word)
    return index, rejects.select("file_path", "line_no", "raw_line")


@dataclass(frozen=True)
class SearchOptions:
    n_features: int = FEATURES_SEARCH
    k: int = TOP_K
    worst_first: bool = False
    field: str = "lemmas"
    learn: LearnOptions = LearnOptions()


def search_by_example(
    index: Index, seeds: DataFrame, options: SearchOptions = SearchOptions()
) -> DataFrame:
    """The best ``k`` unlabelled documents for the ``+`` seeds: (doc_id, score, id, title, snippet)."""
    labels = settle(labels_from_seeds(index, seeds), "labels")
    model = score_counts(count_indexed_terms(index, labels, options.field), options.learn)
    features = top_features(
        model.filter(F.col("klass") == MEMBER), options.n_features, options.learn.nan_policy
    )
    scores = posting_scores(index.searchable(options.field), features)
    best = top_documents(without_labelled(scores, labels).drop("klass"), options.k)
    return present(index, best, options)


def present(index: Index, best: DataFrame, options: SearchOptions) -> DataFrame:
    """Stored fields of the winners, and of no other document."""
    best = settle(best, "winners")
    return (
        index.documents(best)
        .join(best, "doc_id")
        .select(
            "doc_id",
            "score",
            "id",
            F.coalesce("title", F.lit("")).alias("title"),
            snippet(F.col(options.field)).alias("snippet"),
        )
        .orderBy(*result_order(options.worst_first))
    )
