"""Jobs: train from id sets, score a collection, one-against-the-rest experiments, active learning.

Documents come as the corpus table (doc_id, id, title, lemmas, tags); the id tells training
documents from test documents by its prefix. All tags are handled in the same jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedsift.operators.counts import count_indexed_terms, count_terms_one_vs_rest
from seedsift.operators.evaluate import break_even
from seedsift.operators.labels import (
    TEST_PREFIX,
    TRAINING_PREFIX,
    has_prefix,
    labels_from_id_sets,
)
from seedsift.operators.learn import LearnOptions, learn, score_counts, top_features
from seedsift.operators.ranking import example_key
from seedsift.operators.scoring import FEATURES_EXPERIMENT, posting_scores
from seedsift.plans.bounded import keyed_join, scratch_path, settle
from seedsift.plans.prefix import ranks
from seedsift.sources.index import Index, StoredPostings, index_view, tag_array
from seedsift.sources.seeds import MEMBER


@dataclass(frozen=True)
class ExperimentOptions:
    n_features: int = FEATURES_EXPERIMENT
    learn: LearnOptions = LearnOptions()


def train(
    docs: DataFrame | Index, pos: DataFrame, neg: DataFrame, options: LearnOptions = LearnOptions()
) -> DataFrame:
    """A model from positive ids (class 0) and negative ids (class 1). Of an index in files only
    what belongs to these documents is read."""
    labels = labels_from_id_sets(docs, pos, neg)
    if isinstance(docs, Index):
        return score_counts(count_indexed_terms(docs, labels), options)
    return learn(docs, labels, options)


def score_collection(
    docs: DataFrame, term_postings: DataFrame, model: DataFrame, n_features: int = FEATURES_EXPERIMENT
) -> DataFrame:
    """(doc_id, id, score) of every document with one of the best features of class 0."""
    features = top_features(model.filter(F.col("klass") == MEMBER), n_features)
    scores = posting_scores(term_postings, features).select("doc_id", "score")
    return docs.select("doc_id", "id").join(scores, "doc_id")


def with_roles(docs: DataFrame) -> DataFrame:
    """(doc_id, id, lemmas, klasses, is_training, is_test)."""
    return docs.select(
        "doc_id",
        "id",
        "lemmas",
        tag_array().alias("klasses"),
        has_prefix("id", TRAINING_PREFIX).alias("is_training"),
        has_prefix("id", TEST_PREFIX).alias("is_test"),
    )


def class_overview(roles: DataFrame) -> DataFrame:
    """(klass, n_train, n_pos, n_neg, n_gold) for every tag of the corpus."""
    n_train = roles.agg(F.count_if("is_training").alias("n")).scalar()
    return (
        roles.select(F.explode("klasses").alias("klass"), "is_training", "is_test")
        .groupBy("klass")
        .agg(F.count_if("is_training").alias("n_pos"), F.count_if("is_test").alias("n_gold"))
        .select("klass", n_train.alias("n_train"), "n_pos", (n_train - F.col("n_pos")).alias("n_neg"), "n_gold")
    )


def one_vs_rest_model(roles: DataFrame, options: LearnOptions = LearnOptions()) -> DataFrame:
    training = roles.filter("is_training").select("doc_id", "lemmas", "klasses")
    counts = count_terms_one_vs_rest(training)
    return score_counts(counts, options, separate=True)


def with_document_facts(scores: DataFrame, roles: DataFrame) -> DataFrame:
    """Scores with the id, the role of the document and whether it has the tag."""
    facts = roles.select("doc_id", "id", "klasses", "is_training", "is_test")
    return scores.join(facts, "doc_id").select(
        "klass",
        "doc_id",
        "id",
        "score",
        "is_training",
        "is_test",
        F.array_contains("klasses", F.col("klass")).alias("gold"),
    )


def one_vs_rest_scores(
    docs: DataFrame, term_postings: DataFrame | StoredPostings, options: ExperimentOptions = ExperimentOptions()
) -> DataFrame:
    """Scores of all retrieved documents for every tag, with their facts."""
    roles = with_roles(docs)
    model = one_vs_rest_model(roles, options.learn)
    features = top_features(model, options.n_features, options.learn.nan_policy)
    return with_document_facts(posting_scores(term_postings, features), roles)


def one_vs_rest(
    docs: DataFrame, term_postings: DataFrame | StoredPostings, options: ExperimentOptions = ExperimentOptions()
) -> DataFrame:
    """(klass, n_train, n_pos, n_neg, p, r, f1) at the break-even point of every tag."""
    overview = settle(class_overview(with_roles(docs)), "overview")
    scores = one_vs_rest_scores(docs, term_postings, options)
    ranked = scores.filter("is_test").select("klass", "id", "score", "gold")
    return _report(break_even(ranked, overview.select("klass", "n_gold")), overview)


def _report(points: DataFrame, overview: DataFrame) -> DataFrame:
    return overview.drop("n_gold").join(points.select("klass", "p", "r", "f1"), "klass")


def first_examples(labelled: DataFrame, per_class: int = 1, seed: int = 0) -> DataFrame:
    """A repeatable random choice of examples per class, from rows with (klass, id)."""
    best = Window.partitionBy("klass").orderBy(example_key("random", seed), "id")
    numbered = labelled.withColumn("_rank", F.row_number().over(best))
    return numbered.filter(F.col("_rank") <= per_class).drop("_rank")


@dataclass(frozen=True)
class Labelled:
    """What a set of problems has labelled so far, and the counts it has led to.

    ``own`` (klass, doc_id, gold) are documents labelled for one class. ``pool`` (doc_id) are
    labelled for all classes, right where they have the tag: their counts are kept once
    (``every``: term, every) and for the classes they belong to, and the rest is a difference, so
    no document meets a class that it has nothing to do with. ``counts`` (klass, term, in_pool, p,
    n) and ``sizes`` (klass, in_pool, n_pos, n_neg) hold the sums of all that was labelled.
    """

    own: DataFrame
    pool: DataFrame
    n_pool: int
    every: DataFrame
    counts: DataFrame
    sizes: DataFrame

    @staticmethod
    def start(index: Index, seeds: DataFrame | None, pool: DataFrame | None) -> Labelled:
        if seeds is None and pool is None:
            raise ValueError("seeds or a pool of labelled documents must be given")
        numbers = index.docs.select("doc_id")
        pool = settle((numbers.limit(0) if pool is None else pool.select("doc_id")).distinct(), "pool")
        tagged = settle(
            index.documents(pool).select("doc_id", F.explode(tag_array()).alias("klass")), "pool-tags"
        )
        terms = index.term_counts(pool)
        every = settle(terms.groupBy("term").agg(F.sum("tf").alias("every")), "pool-terms")
        in_pool = (
            terms.join(tagged, "doc_id")
            .groupBy("klass", "term")
            .agg(F.sum("tf").alias("in_pool"))
            .select("klass", "term", "in_pool", *_none("p", "n"))
        )
        sizes = tagged.groupBy("klass").agg(F.count(F.lit(1)).alias("in_pool"))
        nothing = tagged.select("klass", "doc_id", F.lit(True).alias("gold")).limit(0)
        start = Labelled(
            nothing,
            pool,
            pool.count(),
            every,
            settle(in_pool, "counts"),
            settle(sizes.select("klass", "in_pool", *_none("n_pos", "n_neg")), "sizes"),
        )
        if seeds is None:
            return start
        return start.with_labels(index, settle(seeds.select("klass", "doc_id", "gold").distinct(), "seeds"))

    def with_labels(self, index: Index, chosen: DataFrame, running: DataFrame | None = None) -> Labelled:
        """After labelling ``chosen`` (klass, doc_id, gold), a settled frame: only the terms of these
        documents are read and added. With ``running`` (klass) all other classes are dropped."""
        gold = F.col("gold")
        terms = index.term_counts(chosen).join(chosen, "doc_id")
        added = terms.groupBy("klass", "term").agg(
            F.sum(F.when(gold, F.col("tf")).otherwise(0)).alias("p"),
            F.sum(F.when(~gold, F.col("tf")).otherwise(0)).alias("n"),
        )
        more = chosen.groupBy("klass").agg(
            F.count_if(gold).alias("n_pos"), F.count_if(~gold).alias("n_neg")
        )
        own, counts, sizes = self.own, self.counts, self.sizes
        if running is not None:
            own, counts, sizes = (
                x.join(running, "klass", "left_semi") for x in (own, counts, sizes)
            )
        counts = counts.unionByName(added.select("klass", "term", *_none("in_pool"), "p", "n"))
        sizes = sizes.unionByName(more.select("klass", *_none("in_pool"), "n_pos", "n_neg"))
        return Labelled(
            settle(own.unionByName(chosen.select("klass", "doc_id", "gold")), "labelled"),
            self.pool,
            self.n_pool,
            self.every,
            settle(_added_up(counts, ["klass", "term"]), "counts"),
            settle(_added_up(sizes, ["klass"]), "sizes"),
        )

    def overview(self) -> DataFrame:
        """(klass, n_train, n_pos, n_neg)"""
        n_pos = F.col("in_pool") + F.col("n_pos")
        n_neg = self.n_pool - F.col("in_pool") + F.col("n_neg")
        return self.sizes.select(
            "klass", (n_pos + n_neg).alias("n_train"), n_pos.alias("n_pos"), n_neg.alias("n_neg")
        )

    def term_counts(self) -> DataFrame:
        """(klass, term, p, n, class_docs, all_docs) of the terms of the classes, for learning."""
        p = F.col("in_pool") + F.col("p")
        n = F.coalesce("every", F.lit(0)) - F.col("in_pool") + F.col("n")
        counted = self.counts.filter(p > 0).join(self.every, "term", "left")
        sizes = self.overview().select(
            "klass", F.col("n_pos").alias("class_docs"), F.col("n_train").alias("all_docs")
        )
        return keyed_join(counted.select("klass", "term", p.alias("p"), n.alias("n")), sizes, ["klass"])

    def without(self, scores: DataFrame) -> DataFrame:
        """Scores (klass, doc_id, ...) of documents that the class has not labelled yet."""
        return scores.join(self.own.select("klass", "doc_id"), ["klass", "doc_id"], "left_anti").join(
            self.pool, "doc_id", "left_anti"
        )


def _none(*names: str) -> list:
    return [F.lit(0).cast("bigint").alias(name) for name in names]


def _added_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def active_learning(
    docs: DataFrame | Index,
    term_postings: DataFrame | StoredPostings,
    seeds: DataFrame | None,
    options: ExperimentOptions = ExperimentOptions(),
    strategy: str = "top",
    batch: int | str = 1,
    max_rounds: int | None = None,
    pool: DataFrame | None = None,
) -> DataFrame:
    """Learn, evaluate, label further examples, repeat until a class retrieves no unlabelled one.

    ``seeds`` holds (klass, doc_id, gold); documents of ``pool`` (doc_id) are labelled for every tag
    that one of them has. ``batch`` documents are labelled per class and round, or with
    ``"double"`` as many as the class has labelled documents already. Returns (klass, round,
    n_train, n_pos, n_neg, p, r, f1).

    Each round is a fixed number of jobs over all classes that are still running, and reads no
    text but that of the documents it has labelled. Its labels, counts and results are written to
    the shared folder, so rounds do not pile up lineage.
    """
    index = docs if isinstance(docs, Index) else index_view(docs)
    spark = index.docs.sparkSession
    log = scratch_path(spark, "rounds")
    roles = with_roles(index.docs)
    gold_sizes = settle(class_overview(roles).select("klass", "n_gold"), "gold-sizes")
    labelled = Labelled.start(index, seeds, pool)
    number = 0
    while max_rounds is None or number < max_rounds:
        overview = settle(labelled.overview().join(gold_sizes, "klass"), "overview")
        model = score_counts(labelled.term_counts(), options.learn, separate=True)
        features = top_features(model, options.n_features, options.learn.nan_policy)
        scores = with_document_facts(posting_scores(term_postings, features), roles)
        useful = settle(
            labelled.without(scores.filter(F.col("is_training") | F.col("is_test"))), "useful"
        )
        points = break_even(useful.filter("is_test"), overview.select("klass", "n_gold"))
        _report(points, overview).withColumn("round", F.lit(number)).write.mode("append").parquet(log)
        number += 1
        if number == max_rounds:
            break
        limit = F.col("n_train") if batch == "double" else F.lit(batch)
        order = [example_key(strategy), F.col("id")]
        candidates = keyed_join(
            ranks(useful.filter("is_training"), ["klass"], order, "position"),
            overview.select("klass", "n_train"),
            ["klass"],
        )
        chosen = settle(
            candidates.filter(F.col("position") <= limit).select("klass", "doc_id", "gold"), "chosen"
        )
        if chosen.isEmpty():
            break
        labelled = labelled.with_labels(index, chosen, chosen.select("klass").distinct())
    return spark.read.parquet(log).select(
        "klass", "round", "n_train", "n_pos", "n_neg", "p", "r", "f1"
    )
