"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables import (
    corpus,
    corpus_file,
    corpus_files,
    in_order,
    rounded,
    seed_lines,
    shown,
    six,
    split_corpus,
    table,
    toxic_labels,
)
from seedsift.functions.ieee import is_member, odds
from seedsift.operators import evaluate as ev
from seedsift.operators import labels as lb
from seedsift.operators.counts import class_sizes, count_terms
from seedsift.operators.feature_scores import FEATURE_SCORES
from seedsift.operators.learn import (
    Collection,
    LearnOptions,
    learn,
    log_priors,
    rank_features,
    score_counts,
    top_features,
    unseen_terms,
)
from seedsift.operators.ranking import full_ranking, next_example
from seedsift.operators.scoring import (
    document_scores,
    posting_scores,
    resume_scores,
    score_indexed_documents,
    stepwise_scores,
)
from seedsift.plans import experiment as ex
from seedsift.plans.bounded import scratch_path, settle
from seedsift.plans.search import SearchOptions, index_corpus, search_by_example
from seedsift.sources import index as ix
from seedsift.sources.corpus import (
    count_without_text,
    number_lines,
    parse_lines,
    read_corpus,
    read_lines,
    rejected_lines,
)
from seedsift.sources.model_store import feature_trace, load_model, model_listing, save_model
from seedsift.sources.reports import write_evaluation, write_results
from seedsift.sources.seeds import MEMBER, parse_seeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEQUENTIAL = LearnOptions(total_mode="sequential", term_order="term")
GIVEN_ORDER = LearnOptions(total_mode="sequential", term_order="given")
LIMIT0 = LearnOptions(nan_policy="limit0")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def toxic_model(spark, sf_dir, options=LearnOptions(), collection=None):
    return learn(
        corpus(spark, sf_dir), toxic_labels(spark, sf_dir), options, collection=collection
    )


def toxic_features(spark, sf_dir, n=50, options=LearnOptions()):
    """The best features of class 0: a few rows that several steps read."""
    model = toxic_model(spark, sf_dir, options).filter(F.col("klass") == MEMBER)
    return settle(top_features(model, n, options.nan_policy), "features")


def text_postings(spark, sf_dir):
    return ix.postings(corpus(spark, sf_dir))


# Sources ---------------------------------------------------------------------------------------


@query
def stored_documents(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.select("doc_id", "id", "title", F.length("lemmas").alias("n_chars"), "tags")


@query
def documents_without_text(spark, sf_dir):
    return count_without_text(corpus(spark, sf_dir))


@query
def postings_build(spark, sf_dir):
    return text_postings(spark, sf_dir)


@query
def title_postings(spark, sf_dir):
    return ix.postings(corpus(spark, sf_dir), "title")


@query
def text_df(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs")).scalar()
    return ix.document_frequency(ix.postings(docs)).withColumn("n_docs", n_docs)


@query
def title_df(spark, sf_dir):
    return ix.document_frequency(ix.postings(corpus(spark, sf_dir), "title"))


@query
def tag_table(spark, sf_dir):
    return ix.doc_tags(corpus(spark, sf_dir))


@query
def documents_with_tag(spark, sf_dir):
    return ix.documents_with_tag(ix.doc_tags(corpus(spark, sf_dir)), "de")


@query
def tsv_valid(spark, sf_dir):
    lines = number_lines(read_lines(spark, corpus_file(spark, sf_dir)))
    return parse_lines(lines).select("line_no", "id", "title", "lemmas", "tags")


@query
def tsv_rejects(spark, sf_dir):
    lines = number_lines(read_lines(spark, corpus_file(spark, sf_dir)))
    return rejected_lines(lines).select("line_no", "raw_line")


@query
def index_from_file_df(spark, sf_dir):
    """The whole indexing job on a corpus file: documents per term of the text, per term of the
    title and per tag, and the number of rejected lines."""
    index, rejects = index_corpus(spark, corpus_file(spark, sf_dir), scratch_path(spark, "index"))
    tags = index.tags.select(F.col("tag").alias("term"), "doc_id")
    figures = [
        ix.document_frequency(postings).select(F.lit(kind).alias("kind"), "term", "df")
        for kind, postings in (("text", index.text), ("title", index.title), ("tag", tags))
    ]
    n_rejects = rejects.agg(F.count(F.lit(1)).alias("df"))
    figures.append(n_rejects.select(F.lit("rejects").alias("kind"), F.lit("").alias("term"), "df"))
    return reduce(DataFrame.unionByName, figures)


# Labels ----------------------------------------------------------------------------------------


@query
def seed_labels(spark, sf_dir):
    """Low quality documents stand under another sign and are skipped."""
    sign = F.expr("CASE WHEN quality = 0 THEN '#' WHEN toxic = 1 THEN '+' ELSE '-' END")
    lines = table(spark, sf_dir, "labels").select(
        F.concat(sign, F.col("doc_id").cast("string")).alias("value")
    )
    return lb.labels_from_seeds(corpus(spark, sf_dir), parse_seeds(lines))


@query
def unknown_seeds(spark, sf_dir):
    strange = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("+item"), F.col("item_id").cast("string")).alias("value")
    )
    seeds = parse_seeds(seed_lines(spark, sf_dir).unionByName(strange))
    return lb.unknown_ids(corpus(spark, sf_dir), seeds).select("klass", "id")


@query
def first_document_of_repeated_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("id"), "doc_id")
    return lb.resolve_ids(docs, docs.select("id").dropDuplicates())


@query
def first_document_of_several_files(spark, sf_dir):
    """The first document of a repeated id is the one in the first file, whatever the sizes."""
    docs = read_corpus(spark, corpus_files(spark, sf_dir))
    first = lb.resolve_ids(docs, docs.select("id").dropDuplicates())
    return docs.join(first, ["id", "doc_id"]).select(
        "id", "doc_id", F.col("title").cast("bigint").alias("first_doc")
    )


@query
def training_test_split(spark, sf_dir):
    docs = split_corpus(spark, sf_dir)
    return docs.select(
        "doc_id",
        lb.has_prefix("id", lb.TRAINING_PREFIX).alias("is_training"),
        lb.has_prefix("id", lb.TEST_PREFIX).alias("is_test"),
    )


@query
def complement_negatives(spark, sf_dir):
    training = toxic_labels(spark, sf_dir)
    pos = training.filter(F.col("klass") == MEMBER)
    return lb.complement(training.select("doc_id"), pos)


@query
def labels_union(spark, sf_dir):
    quality = table(spark, sf_dir, "labels").select(
        F.col("quality").cast("int").alias("klass"), "doc_id"
    )
    return lb.union_labels(toxic_labels(spark, sf_dir), quality)


@query
def label_sizes(spark, sf_dir):
    return class_sizes(toxic_labels(spark, sf_dir).dropDuplicates())


# Learning --------------------------------------------------------------------------------------


@query
def class_priors(spark, sf_dir):
    return shown(log_priors(toxic_labels(spark, sf_dir)), "log_prior")


@query
def class_priors_sequential(spark, sf_dir):
    labels = toxic_labels(spark, sf_dir)
    drift = unseen_terms(count_terms(corpus(spark, sf_dir), labels))
    return shown(log_priors(labels, drift), "log_prior")


@query
def term_counts(spark, sf_dir):
    counts = count_terms(corpus(spark, sf_dir), toxic_labels(spark, sf_dir))
    return counts.select("klass", "term", "p", "n", "class_docs", "all_docs")


MODEL_COLUMNS = ("klass", "term", "p", "n", "nc", "total", "log_likelihood")


@query
def model_local(spark, sf_dir):
    model = toxic_model(spark, sf_dir)
    return shown(model.select(*MODEL_COLUMNS), "log_likelihood")


@query
def model_sequential(spark, sf_dir):
    model = toxic_model(spark, sf_dir, SEQUENTIAL)
    return shown(model.select(*MODEL_COLUMNS), "log_likelihood")


@query
def model_given_order(spark, sf_dir):
    """The total grows along an order of the caller's: short terms first."""
    docs, labels = corpus(spark, sf_dir), toxic_labels(spark, sf_dir)
    counts = count_terms(docs, labels)
    places = counts.select("klass", "term", F.length("term").alias("place"))
    model = score_counts(counts, GIVEN_ORDER, places=places)
    return shown(model.select(*MODEL_COLUMNS), "log_likelihood")


def ranked_scores(model, nan_policy="ieee"):
    ranked = rank_features(model, nan_policy).select("klass", "rank", "term", "score")
    return shown(ranked, "score")


@query
def feature_ig_rank(spark, sf_dir):
    return ranked_scores(toxic_model(spark, sf_dir))


@query
def feature_ig_rank_limit0(spark, sf_dir):
    return ranked_scores(toxic_model(spark, sf_dir, LIMIT0), "limit0")


@query
def feature_best_50(spark, sf_dir):
    best = top_features(toxic_model(spark, sf_dir), 50)
    return shown(best.select("klass", "rank", "term", "score"), "score")


def collection_of(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    return Collection(ix.document_frequency(ix.postings(docs)), n_docs)


def score_query(name: str, options: LearnOptions) -> None:
    def run(spark, sf_dir):
        model = toxic_model(spark, sf_dir, options, collection_of(spark, sf_dir))
        return shown(model.select("klass", "term", "score"), "score")

    run.__name__ = f"feature_score_{name}"
    query(run)


for _name in FEATURE_SCORES:
    score_query(_name, LearnOptions(score=_name))
score_query("collection_pt", LearnOptions(score="mi_term", collection_pt=True))
score_query("positive_only", LearnOptions(positive_only=True))


@query
def likelihood_odds(spark, sf_dir):
    model = toxic_model(spark, sf_dir, LearnOptions(likelihood="odds"))
    return shown(model.select("klass", "term", "log_likelihood"), "log_likelihood")


@query
def likelihood_odds_share(spark, sf_dir):
    model = toxic_model(spark, sf_dir, LearnOptions(likelihood="odds_share"))
    return shown(model.select("klass", "term", "log_likelihood"), "log_likelihood")


@query
def model_saved_and_loaded(spark, sf_dir):
    path = scratch_path(spark, "model")
    ranked = rank_features(toxic_model(spark, sf_dir))
    save_model(ranked, log_priors(toxic_labels(spark, sf_dir)), path)
    terms, priors = load_model(spark, path)
    both = terms.select("klass", "rank", "term", "log_likelihood").join(priors, "klass")
    return shown(both, "log_likelihood", "log_prior")


@query
def model_listing_lines(spark, sf_dir):
    """The weights are rounded before they are printed."""
    ranked = rank_features(toxic_model(spark, sf_dir)).withColumn(
        "log_likelihood", F.col("log_likelihood").cast("decimal(18,6)")
    )
    return model_listing(ranked)


@query
def feature_trace_51(spark, sf_dir):
    trace = feature_trace(toxic_features(spark, sf_dir, 51), MEMBER, 51)
    return rounded(trace, "log_likelihood")


# Scoring ---------------------------------------------------------------------------------------


@query
def score_postings_50(spark, sf_dir):
    scores = posting_scores(text_postings(spark, sf_dir), toxic_features(spark, sf_dir, 50))
    return rounded(scores, "score")


@query
def score_postings_51(spark, sf_dir):
    scores = posting_scores(text_postings(spark, sf_dir), toxic_features(spark, sf_dir, 51))
    return rounded(scores, "score")


@query
def score_postings_sequential(spark, sf_dir):
    features = toxic_features(spark, sf_dir, 50, SEQUENTIAL)
    return rounded(posting_scores(text_postings(spark, sf_dir), features), "score")


@query
def score_docs_all(spark, sf_dir):
    model = toxic_model(spark, sf_dir)
    return rounded(document_scores(corpus(spark, sf_dir), model, MEMBER), "score")


@query
def score_docs_best_50(spark, sf_dir):
    model = toxic_model(spark, sf_dir)
    return rounded(document_scores(corpus(spark, sf_dir), model, MEMBER, 50), "score")


@query
def score_docs_no_feature(spark, sf_dir):
    model = toxic_model(spark, sf_dir)
    return rounded(document_scores(corpus(spark, sf_dir), model, MEMBER, 0), "score")


def stored_index(spark, sf_dir):
    return ix.build_index(corpus(spark, sf_dir), scratch_path(spark, "index"))


@query
def score_stored_documents(spark, sf_dir):
    """The labelled documents, looked up by number in a stored index and scored with all features."""
    ids = toxic_labels(spark, sf_dir).select("doc_id")
    index = stored_index(spark, sf_dir)
    scores = score_indexed_documents(index, ids, toxic_model(spark, sf_dir), MEMBER)
    return rounded(scores, "score")


@query
def score_conversations(spark, sf_dir):
    """Texts that are not in the corpus, scored by the model of the corpus."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"),
        F.regexp_replace("text", "[\t\n\r]+", " ").alias("lemmas"),
    )
    return rounded(document_scores(turns, toxic_model(spark, sf_dir), MEMBER), "score")


@query
def step_scores(spark, sf_dir):
    steps = stepwise_scores(text_postings(spark, sf_dir), toxic_features(spark, sf_dir, 50))
    return rounded(steps, "log_score")


@query
def resumed_scores(spark, sf_dir):
    """20 steps, then up to 40 more over a list of 50."""
    features = toxic_features(spark, sf_dir, 50)
    term_postings = text_postings(spark, sf_dir)
    start = posting_scores(term_postings, features.filter(F.col("rank") <= 20))
    return rounded(resume_scores(start, term_postings, features, 19, 40), "score")


@query
def member_flags(spark, sf_dir):
    scores = posting_scores(text_postings(spark, sf_dir), toxic_features(spark, sf_dir, 50))
    return scores.select(
        "doc_id",
        is_member(F.col("score")).alias("is_member"),
        F.format_string("%.6e", odds(F.col("score"))).alias("odds"),
    )


# Search ----------------------------------------------------------------------------------------


@query
def search_top20(spark, sf_dir):
    index = ix.index_view(corpus(spark, sf_dir))
    found = search_by_example(index, parse_seeds(seed_lines(spark, sf_dir)))
    return rounded(in_order(found), "score")


@query
def search_stored_index_top20(spark, sf_dir):
    found = search_by_example(stored_index(spark, sf_dir), parse_seeds(seed_lines(spark, sf_dir)))
    return rounded(found, "score")


@query
def search_result_lines(spark, sf_dir):
    """The printed form of a search, through the text sink."""
    path = scratch_path(spark, "results")
    write_results(search_top20(spark, sf_dir).drop("position"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def search_quality_worst_first(spark, sf_dir):
    index = ix.index_view(corpus(spark, sf_dir))
    seeds = parse_seeds(seed_lines(spark, sf_dir, "quality"))
    found = search_by_example(index, seeds, SearchOptions(worst_first=True))
    return rounded(in_order(found), "score")


@query
def search_titles_top20(spark, sf_dir):
    index = ix.index_view(corpus(spark, sf_dir))
    seeds = parse_seeds(seed_lines(spark, sf_dir))
    return rounded(search_by_example(index, seeds, SearchOptions(field="title")), "score")


@query
def unlabelled_ranking(spark, sf_dir):
    """All retrieved documents without the seeds, best first."""
    return rounded(in_order(full_ranking(_unlabelled_scores(spark, sf_dir))), "score")


def _unlabelled_scores(spark, sf_dir):
    docs, labels = corpus(spark, sf_dir), toxic_labels(spark, sf_dir)
    model = learn(docs, labels)
    scored = ex.score_collection(docs, ix.postings(docs), model)
    return lb.without_labelled(scored, labels).select("id", "score")


def _candidates(spark, sf_dir):
    """Training documents that are not labelled: labels of high quality are known, all others
    still to be given."""
    docs = split_corpus(spark, sf_dir)
    known = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    labels = toxic_labels(spark, sf_dir).join(known, "doc_id", "left_semi")
    scored = ex.score_collection(docs, ix.postings(docs), learn(docs, labels))
    return lb.unlabelled_training(scored, labels).select("id", "score")


@query
def next_example_top(spark, sf_dir):
    return rounded(next_example(_candidates(spark, sf_dir)), "score")


@query
def next_example_uncertain(spark, sf_dir):
    return rounded(next_example(_candidates(spark, sf_dir), "uncertain"), "score")


@query
def next_example_random(spark, sf_dir):
    return rounded(next_example(_candidates(spark, sf_dir), "random", seed=7), "score")


# Experiments -----------------------------------------------------------------------------------


def _id_sets(spark, sf_dir):
    ids = toxic_labels(spark, sf_dir).select("klass", F.col("doc_id").cast("string").alias("id"))
    return ids.filter("klass = 0").select("id"), ids.filter("klass = 1").select("id")


@query
def train_from_id_sets(spark, sf_dir):
    model = ex.train(corpus(spark, sf_dir), *_id_sets(spark, sf_dir))
    return shown(model.select("klass", "term", "log_likelihood"), "log_likelihood")


@query
def train_from_stored_index(spark, sf_dir):
    """Ids and terms of the labelled documents are looked up in a stored index."""
    model = ex.train(stored_index(spark, sf_dir), *_id_sets(spark, sf_dir))
    return shown(model.select("klass", "term", "log_likelihood"), "log_likelihood")


@query
def forward_index(spark, sf_dir):
    """Every document's terms that learning counts, with their occurrences."""
    stored = stored_index(spark, sf_dir).stored
    return stored.forward.rows.select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"))


@query
def lexicon_df(spark, sf_dir):
    """Documents per term, by the lexicons of a stored index alone."""
    stored = stored_index(spark, sf_dir).stored
    fields = [("text", stored.text), ("title", stored.title)]
    return reduce(
        DataFrame.unionByName,
        [p.document_frequency().select(F.lit(name).alias("field"), "term", "df") for name, p in fields],
    )


@query
def score_collection(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    scored = ex.score_collection(docs, ix.postings(docs), toxic_model(spark, sf_dir))
    return rounded(scored, "score")


def _tag_scores(spark, sf_dir):
    docs = split_corpus(spark, sf_dir)
    scores = ex.one_vs_rest_scores(docs, ix.postings(docs))
    sizes = ex.class_overview(ex.with_roles(docs)).select("klass", "n_gold")
    return scores.filter("is_test").select("klass", "id", "score", "gold"), sizes


@query
def gold_flags(spark, sf_dir):
    docs = split_corpus(spark, sf_dir)
    scores = ex.one_vs_rest_scores(docs, ix.postings(docs)).drop("gold")
    tags = ix.doc_tags(docs).withColumnRenamed("tag", "klass")
    return lb.with_gold_flag(scores, tags, ["klass", "doc_id"]).select("klass", "id", "gold")


@query
def confusion_counts(spark, sf_dir):
    return ev.confusion(_tag_scores(spark, sf_dir)[0])


@query
def pr_curve(spark, sf_dir):
    curve = ev.precision_recall_curve(*_tag_scores(spark, sf_dir))
    return shown(curve.select("klass", "position", "id", "tp", "p", "r", "f1"), "p", "r", "f1")


@query
def break_even_points(spark, sf_dir):
    return shown(ev.break_even(*_tag_scores(spark, sf_dir)), "p", "r", "f1")


@query
def class_overview(spark, sf_dir):
    return ex.class_overview(ex.with_roles(split_corpus(spark, sf_dir)))


@query
def one_vs_rest_tags(spark, sf_dir):
    docs = split_corpus(spark, sf_dir)
    return shown(ex.one_vs_rest(docs, ix.postings(docs)), "p", "r", "f1")


@query
def one_vs_rest_sequential(spark, sf_dir):
    docs = split_corpus(spark, sf_dir)
    options = ex.ExperimentOptions(learn=SEQUENTIAL)
    return shown(ex.one_vs_rest(docs, ix.postings(docs), options), "p", "r", "f1")


@query
def active_learning_rounds(spark, sf_dir):
    """All tags, learned from eight examples of each; what a class has labelled doubles every round."""
    docs = split_corpus(spark, sf_dir)
    index = ix.build_index(docs, scratch_path(spark, "index"))
    tagged = ex.with_roles(index.docs).filter("is_training").select(
        "doc_id", "id", F.explode("klasses").alias("klass")
    )
    pool = ex.first_examples(tagged, per_class=8, seed=7).select("doc_id")
    rounds = ex.active_learning(
        index, index.searchable(), None, batch="double", max_rounds=3, pool=pool
    )
    return shown(rounds, "p", "r", "f1")


@query
def evaluation_report(spark, sf_dir):
    """The printed report of the experiment over all tags, through the text sink."""
    path = scratch_path(spark, "evaluation")
    docs = split_corpus(spark, sf_dir)
    report = ex.one_vs_rest(docs, ix.postings(docs))
    figures = [
        F.when(F.isnan(c), F.lit("NaN")).otherwise(six(F.col(c)).cast("decimal(9,6)").cast("string")).alias(c)
        for c in ("p", "r", "f1")
    ]
    write_evaluation(report.select("klass", "n_train", "n_pos", "n_neg", *figures), path)
    return spark.read.text(path).withColumnRenamed("value", "line")
