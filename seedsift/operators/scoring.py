"""Scores of documents: through postings, step by step, or token by token.

Posting scores count a (document, term) pair once and return only documents with a selected
feature. Document scores count every token occurrence and return 0.0 for a document without any.

Scores are never rounded. The few hits of a document on selected features are added up in the order
of their ranks, as a walk from feature to feature does, so step by step gives the same doubles as
all at once. The many tokens of a document are added up where they are found, by a sum that does
not depend on the order (``functions/exact.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.functions.exact import exact_sum
from seedsift.functions.text import space_tokens
from seedsift.operators.learn import top_features
from seedsift.plans.bounded import (
    BROADCAST_BYTES,
    HOT_SHARE,
    hot_split_join,
    measured_bytes,
    settle,
)
from seedsift.sources.index import Index, StoredPostings

FEATURES_EXPERIMENT = 50
FEATURES_SEARCH = 51  # the search tool stops after the step with index 50

_FEATURE_COLUMNS = ("klass", "term", "rank", "log_likelihood")


def posting_hits(term_postings: DataFrame | StoredPostings, features: DataFrame) -> DataFrame:
    """The postings of the selected features: (klass, term, rank, log_likelihood, doc_id).

    The features are written out and measured. Stored postings are read only where these terms are,
    however many there are; the join is a broadcast of a list that has been measured to be small, or
    a shuffle with its hot terms split.
    """
    features = settle(features.select(*_FEATURE_COLUMNS), "features")
    if isinstance(term_postings, StoredPostings):
        term_postings = term_postings.near(features)
    return _weighted(term_postings, features, measured_bytes(features), "inner")


def _weighted(
    rows: DataFrame,
    weights: DataFrame,
    n_bytes: int,
    how: str,
    max_bytes: int = BROADCAST_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    if n_bytes <= max_bytes:
        return rows.join(F.broadcast(weights), "term", how)
    return hot_split_join(rows, weights, ["term"], how, hot_share)


def _summed(rank: str, value: str) -> Column:
    """The sum of the values in the order of ``rank``; at most as many as there are features."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(value).alias("v"))))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part["v"])


def posting_scores(term_postings: DataFrame | StoredPostings, features: DataFrame) -> DataFrame:
    """(klass, doc_id, score): the sum over the distinct selected terms of a document."""
    hits = posting_hits(term_postings, features)
    return hits.groupBy("klass", "doc_id").agg(_summed("rank", "log_likelihood").alias("score"))


def stepwise_scores(term_postings: DataFrame, features: DataFrame) -> DataFrame:
    """(klass, doc_id, iteration, log_score) at each step that changes the score of a document.

    The score after any step i is the one with the highest iteration up to i. A window holds
    the hits of one document, as many as there are features at most.
    """
    steps = (
        Window.partitionBy("klass", "doc_id")
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return posting_hits(term_postings, features).select(
        "klass",
        "doc_id",
        (F.col("rank") - 1).alias("iteration"),
        F.sum("log_likelihood").over(steps).alias("log_score"),
    )


def resume_scores(
    previous: DataFrame, term_postings: DataFrame, features: DataFrame, from_iteration: int, n: int
) -> DataFrame:
    """Scores after ``n`` more features than those up to step ``from_iteration``.

    Past the last feature nothing changes.
    """
    done = from_iteration + 1
    further = features.filter((F.col("rank") > done) & (F.col("rank") <= done + n))
    added = posting_hits(term_postings, further).select(
        "klass", "doc_id", F.col("log_likelihood").alias("score"), "rank"
    )
    return (
        previous.select("klass", "doc_id", "score", F.lit(0).cast("int").alias("rank"))
        .unionByName(added)
        .groupBy("klass", "doc_id")
        .agg(_summed("rank", "score").alias("score"))
    )


@dataclass(frozen=True)
class Weights:
    """The terms of one class with their log-likelihoods, written out and measured once."""

    terms: DataFrame
    n_bytes: int


def class_weights(model: DataFrame, klass, n: int = -1, nan_policy: str = "ieee") -> Weights:
    """Of all features or the best ``n``; a negative ``n`` means all, one above their number too."""
    chosen = model.filter(F.col("klass") == klass)
    if n >= 0:
        chosen = top_features(chosen, n, nan_policy)
    terms = settle(chosen.select("term", "log_likelihood"), "weights")
    return Weights(terms, measured_bytes(terms))


def score_documents(
    docs: DataFrame,
    weights: Weights,
    text_col: str = "lemmas",
    max_bytes: int = BROADCAST_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` by weights that are there already."""
    rows = docs.select("doc_id", text_col).withColumn("_row", F.monotonically_increasing_id())
    tokens = rows.select(
        "_row", "doc_id", F.explode_outer(space_tokens(F.col(text_col))).alias("term")
    )
    weighted = _weighted(tokens, weights.terms, weights.n_bytes, "left", max_bytes, hot_share)
    scored = weighted.groupBy("_row", "doc_id").agg(exact_sum("log_likelihood").alias("score"))
    return scored.drop("_row")


def document_scores(
    docs: DataFrame,
    model: DataFrame,
    klass,
    n: int = -1,
    text_col: str = "lemmas",
    nan_policy: str = "ieee",
    max_bytes: int = BROADCAST_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """(doc_id, score) of every document for one class, by all features or the best ``n``."""
    weights = class_weights(model, klass, n, nan_policy)
    return score_documents(docs, weights, text_col, max_bytes, hot_share)


def score_indexed_documents(
    index: Index,
    ids: DataFrame,
    model: DataFrame,
    klass,
    n: int = -1,
    nan_policy: str = "ieee",
    max_bytes: int = BROADCAST_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Document scores of indexed documents given by ``doc_id``, however many: only their parts of
    the forward index are read, and each distinct term counts by its occurrences."""
    wanted = settle(ids.select("doc_id").dropna().distinct(), "scored-ids")
    weights = class_weights(model, klass, n, nan_policy)
    counted = _weighted(
        index.term_counts(wanted), weights.terms, weights.n_bytes, "inner", max_bytes, hot_share
    )
    sums = counted.groupBy("doc_id").agg(exact_sum("log_likelihood", "tf").alias("score"))
    known = index.documents(wanted).select("doc_id")
    return known.join(sums, "doc_id", "left").select(
        "doc_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )


@dataclass(frozen=True)
class Iteration:
    """The scores after the step with this number; later steps do not change it."""

    number: int
    scores: DataFrame

    def log_score(self, doc_id) -> float | None:
        row = self.scores.filter(F.col("doc_id") == doc_id).first()
        return None if row is None else row["score"]


class StepSearch:
    """Visits the postings of a class feature by feature, best first.

    ``ranked`` is the ranked model; ``n_features`` how many steps there are.
    """

    def __init__(self, term_postings: DataFrame | StoredPostings, ranked: DataFrame, klass):
        self._postings = term_postings
        self.features = ranked.filter(F.col("klass") == klass)
        self.n_features = self.features.count()

    def has_next(self, previous: Iteration | None) -> bool:
        return self.n_features > (0 if previous is None else previous.number + 1)

    def step(self, previous: Iteration | None = None) -> Iteration | None:
        return self.steps(previous, 1)

    def steps(self, previous: Iteration | None, n: int) -> Iteration | None:
        """Up to ``n`` further steps in one job; at the end the last iteration comes back."""
        if n <= 0 or not self.has_next(previous):
            return previous
        if previous is None:
            first = self.features.filter(F.col("rank") <= n)
            return Iteration(
                min(n, self.n_features) - 1, posting_scores(self._postings, first)
            )
        scores = resume_scores(previous.scores, self._postings, self.features, previous.number, n)
        # Written out, so that a long series of steps does not pile up lineage.
        return Iteration(min(previous.number + n, self.n_features - 1), settle(scores, "step"))
