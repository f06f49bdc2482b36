"""Learning: log-likelihood ratios, priors and the ranking of features.

The model is a table (klass, term, p, n, nc, class_docs, total, log_likelihood, score).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.functions.ieee import ieee_log
from seedsift.operators.counts import class_sizes, count_terms, with_total
from seedsift.operators.feature_scores import (
    NEEDS_COLLECTION,
    feature_score,
    with_probabilities,
)
from seedsift.plans.prefix import prefix_sums, ranks

# Spark limits each map task to the best n rows before the shuffle only below this rank.
GROUP_LIMIT = 1000


@dataclass(frozen=True)
class LearnOptions:
    """``total_mode``: ``local`` smooths the document total per term; ``sequential`` lets it grow
    from term to term, as the reference's loop does, in ``term_order``: by ``term``, or as
    ``given`` by a table of places (klass, term, place). ``nan_policy``: ``ieee`` ranks NaN scores first, ``limit0`` takes 0 ln 0 = 0
    and ranks what is still NaN last."""

    total_mode: str = "local"
    term_order: str = "term"
    score: str = "ig"
    likelihood: str = "ratio"
    nan_policy: str = "ieee"
    collection_pt: bool = False
    positive_only: bool = False

    def __post_init__(self):
        for name, allowed in (
            ("total_mode", ("local", "sequential")),
            ("term_order", ("term", "given")),
            ("likelihood", ("ratio", "odds", "odds_share")),
            ("nan_policy", ("ieee", "limit0")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")

    @property
    def needs_places(self) -> bool:
        return self.total_mode == "sequential" and self.term_order == "given"


@dataclass(frozen=True)
class Collection:
    """What the collection based scores need: ``df`` per term and the one-row ``n_docs``."""

    df: DataFrame
    n_docs: DataFrame


def learn(
    docs: DataFrame,
    labels: DataFrame,
    options: LearnOptions = LearnOptions(),
    text_col: str = "lemmas",
    collection: Collection | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """The model of every class in ``labels`` (klass, doc_id), each against the others."""
    counts = count_terms(docs, labels, text_col)
    return score_counts(counts, options, collection=collection, places=places)


def score_counts(
    counts: DataFrame,
    options: LearnOptions = LearnOptions(),
    separate: bool = False,
    collection: Collection | None = None,
    places: DataFrame | None = None,
) -> DataFrame:
    """Smoothing, log-likelihood and feature score of counted terms.

    ``separate``: the classes are trained one by one (one against the rest), so that a running
    total starts afresh for each of them.
    """
    smoothed = smooth(with_running_total(counts, options, separate, places))
    scored = smoothed.withColumn("log_likelihood", log_likelihood(options.likelihood))
    if options.positive_only:
        scored = scored.filter(F.col("log_likelihood") > 0)
    if options.collection_pt or options.score in NEEDS_COLLECTION:
        if collection is None:
            raise ValueError("this score needs the document frequencies of the collection")
        # Every training term is in the collection unless the index cut its document short.
        scored = (
            scored.join(collection.df, "term", "left")
            .withColumn("df", F.coalesce(F.col("df"), F.lit(0)).cast("double"))
            .withColumn("n_docs", collection.n_docs.scalar().cast("double"))
        )
    return with_probabilities(scored, options.collection_pt).select(
        "klass",
        "term",
        "p",
        "n",
        "nc",
        "class_docs",
        "total",
        "log_likelihood",
        feature_score(options.score, options.nan_policy).alias("score"),
    )


def with_running_total(
    counts: DataFrame, options: LearnOptions, separate: bool, places: DataFrame | None = None
) -> DataFrame:
    """Adds ``unseen`` (no negative occurrence) and ``total``. Terms without a place come last."""
    counts = counts.withColumn("unseen", (F.col("n") == 0).cast("bigint"))
    if options.total_mode == "local":
        return counts.withColumn("total", F.col("all_docs") + F.col("unseen"))
    order = [F.col("term")]
    if options.needs_places:
        if places is None:
            raise ValueError("this order needs a table of places")
        counts = counts.join(places.select("klass", "term", "place"), ["klass", "term"], "left")
        order = [F.col("place").asc_nulls_last(), *order]
    if separate:
        group = ["klass"]
    else:
        counts, group, order = counts.withColumn("_all", F.lit(0)), ["_all"], [F.col("klass"), *order]
    drifted = prefix_sums(counts, group, order, {"_drift": F.col("unseen")})
    return drifted.withColumn("total", F.col("all_docs") + F.col("_drift"))


def smooth(counts: DataFrame) -> DataFrame:
    """Add-one smoothing of terms without a negative occurrence, counts as doubles."""
    return counts.selectExpr(
        "klass",
        "term",
        "double(p) AS p",
        "double(n + unseen) AS n",
        "double(class_docs + unseen) AS nc",
        "double(class_docs) AS class_docs",
        "double(total) AS total",
    )


def log_likelihood(kind: str = "ratio") -> Column:
    """``ratio``: ln p - ln nc - ln n + ln(total - nc), in this order: it decides exact zeros."""
    ln_p, ln_n = ieee_log("p"), ieee_log("n")
    formulas = {
        "ratio": f"{ln_p} - {ieee_log('nc')} - {ln_n} + {ieee_log('total - nc')}",
        "odds": f"{ln_p} - {ln_n}",
        "odds_share": f"{ln_p} - {ln_n} - {ieee_log('p + n')}",
    }
    return F.expr(formulas[kind])


def log_priors(labels: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """(klass, class_docs, log_prior) = ln class_docs - ln(all - class_docs); not used in scoring.

    With ``drift`` (klass, unseen) of the sequential mode, the terms a class had unseen enlarge
    the total of all later classes.
    """
    sizes = with_total(class_sizes(labels.select("klass", "doc_id").dropDuplicates()))
    if drift is not None:
        filled = sizes.join(drift, "klass", "left").withColumns(
            {"unseen": F.coalesce(F.col("unseen"), F.lit(0)), "_all": F.lit(0)}
        )
        earlier = prefix_sums(filled, ["_all"], [F.col("klass")], {"_drift": F.col("unseen")})
        sizes = earlier.withColumn(
            "all_docs", F.col("all_docs") + F.col("_drift") - F.col("unseen")
        )
    inside, rest = "double(class_docs)", "double(all_docs - class_docs)"
    return sizes.selectExpr(
        "klass", "class_docs", f"{ieee_log(inside)} - {ieee_log(rest)} AS log_prior"
    )


def unseen_terms(counts: DataFrame) -> DataFrame:
    """(klass, unseen): terms of a class that no other class has."""
    return counts.groupBy("klass").agg(F.count_if(F.col("n") == 0).alias("unseen"))


def rank_order(nan_policy: str = "ieee") -> list[Column]:
    """Best feature first, the term breaks ties. Scores come from the counts of one row, so equal
    counts give equal doubles and nothing needs rounding."""
    score = F.col("score")
    if nan_policy == "limit0":
        return [F.when(~F.isnan("score"), score).desc_nulls_last(), F.col("term")]
    return [score.desc(), F.col("term")]


def rank_features(model: DataFrame, nan_policy: str = "ieee") -> DataFrame:
    """The whole model with ``rank`` per class, however large a class is."""
    return ranks(model, ["klass"], rank_order(nan_policy), "rank")


def top_features(model: DataFrame, n: int, nan_policy: str = "ieee") -> DataFrame:
    """The best ``n`` features per class; every map task forwards at most n rows a class."""
    if n < 0:
        return rank_features(model, nan_policy)
    if n >= GROUP_LIMIT:
        return rank_features(model, nan_policy).filter(F.col("rank") <= n)
    best = Window.partitionBy("klass").orderBy(*rank_order(nan_policy))
    return model.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
