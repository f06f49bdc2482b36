import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from seedsift.functions.ieee import is_member
from seedsift.operators.counts import count_terms, count_terms_by_problem, count_terms_one_vs_rest
from seedsift.operators.feature_scores import FEATURE_SCORES
from seedsift.operators.learn import (
    Collection,
    LearnOptions,
    learn,
    log_priors,
    rank_features,
    score_counts,
    top_features,
)
from seedsift.operators.scoring import (
    StepSearch,
    document_scores,
    posting_scores,
    resume_scores,
    score_indexed_documents,
    stepwise_scores,
)
from seedsift.plans.bounded import pin
from seedsift.sources.corpus import corpus_from_rows
from seedsift.sources.index import document_frequency, index_view, postings


def random_texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    return {i: " ".join(rng.choices(words, k=rng.randint(1, 25))) for i in range(n)}


TEXTS = random_texts(40, 3)
PLACES = "klass int, term string, place bigint"
LABELS = {0: [1, 4, 7, 10, 13], 1: [2, 3, 5, 8, 11, 12], 2: [0, 1, 9]}  # document 1 has two classes


@pytest.fixture(scope="module")
def docs(spark):
    return corpus_from_rows(spark, [(str(i), None, t, None) for i, t in TEXTS.items()])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, d) for k, ds in LABELS.items() for d in ds]
    return spark.createDataFrame(rows + rows[:2], "klass int, doc_id bigint")  # with duplicates


@pytest.mark.parametrize(
    "options, mode, order",
    [
        (LearnOptions(), "local", sorted),
        (LearnOptions("sequential", "term"), "sequential", sorted),
        (LearnOptions("sequential", "given"), "sequential", brute.table_order),
    ],
)
def test_model_equals_brute_force(spark, docs, labels, options, mode, order):
    want = brute.learn(TEXTS, LABELS, mode, order)
    got = {}
    places = spark.createDataFrame(brute.table_places(TEXTS, LABELS), PLACES)
    for r in learn(docs, labels, options, places=places).collect():
        got.setdefault(r["klass"], {})[r["term"]] = (r["total"], r["log_likelihood"], r["score"])
    assert got.keys() == want.keys()
    for klass in want:
        assert got[klass].keys() == want[klass].keys()
        for term, numbers in want[klass].items():
            assert got[klass][term] == pytest.approx(numbers, abs=1e-12, nan_ok=True), term


def test_ranking_equals_brute_force_and_short_lists_are_its_start(docs, labels):
    model = pin(learn(docs, labels))
    want = brute.learn(TEXTS, LABELS)
    ranked = rank_features(model).collect()
    for klass in LABELS:
        got = [r["term"] for r in sorted(ranked, key=lambda r: r["rank"]) if r["klass"] == klass]
        assert got == brute.ranking(want[klass])
    for n in (0, 1, 7, 5000):
        best = {(r["klass"], r["rank"], r["term"]) for r in top_features(model, n).collect()}
        assert best == {(r["klass"], r["rank"], r["term"]) for r in ranked if r["rank"] <= n}
    assert top_features(model, -1).count() == len(ranked)


def test_limit0_ranks_what_is_left_of_nan_last(docs, labels):
    ranked = rank_features(learn(docs, labels, LearnOptions(nan_policy="limit0")), "limit0").collect()
    for klass in LABELS:
        scores = [r["score"] for r in sorted(ranked, key=lambda r: r["rank"]) if r["klass"] == klass]
        states = [math.isnan(s) for s in scores]
        assert states == sorted(states)


def test_positive_counts_add_up(docs, labels):
    for r in count_terms(docs, labels).groupBy("term").agg(F.sum("p").alias("s"), F.max(F.col("p") + F.col("n")).alias("all")).collect():
        assert r["s"] == r["all"]


def test_one_class_alone_has_infinite_odds(docs, spark):
    labels = spark.createDataFrame([(1, 0), (1, 2)], "klass int, doc_id bigint")
    assert {r["log_likelihood"] for r in learn(docs, labels).collect()} == {-math.inf}
    assert log_priors(labels).first()["log_prior"] == math.inf


def test_unknown_options_are_refused():
    with pytest.raises(ValueError):
        LearnOptions(total_mode="global")
    with pytest.raises(ValueError):
        LearnOptions(nan_policy="drop")


def test_every_score_can_be_learned(docs, labels):
    collection = Collection(document_frequency(postings(docs)), docs.agg(F.count(F.lit(1)).alias("n")))
    n_terms = learn(docs, labels).count()
    for name in FEATURE_SCORES:
        model = learn(docs, labels, LearnOptions(score=name), collection=collection)
        assert model.filter(F.col("score").isNotNull()).count() == n_terms, name
    with pytest.raises(ValueError):
        learn(docs, labels, LearnOptions(score="df"))


def test_one_vs_rest_counts_equal_one_problem_per_class(docs, spark):
    tags = {0: ["x", "y"], 1: ["x"], 2: [], 3: ["y"], 4: ["z"], 5: ["x"]}
    training = docs.filter("doc_id <= 5").withColumn(
        "klasses",
        F.udf(lambda d: tags[d], "array<string>")("doc_id"),
    )
    got = count_terms_one_vs_rest(training)
    labelled = spark.createDataFrame(
        [(k, d, k in own) for d, own in tags.items() for k in "xyz"], "klass string, doc_id bigint, gold boolean"
    )
    want = count_terms_by_problem(docs, labelled)
    columns = ["klass", "term", "p", "n", "class_docs", "all_docs"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    for klass in "xyz":
        classes = {0: [d for d in tags if klass in tags[d]], 1: [d for d in tags if klass not in tags[d]]}
        for mode, order, options in (
            ("local", sorted, LearnOptions()),
            ("sequential", sorted, LearnOptions("sequential", "term")),
        ):
            expected = brute.learn(TEXTS, classes, mode, order)[0]
            model = score_counts(got, options, separate=True).filter(F.col("klass") == klass)
            totals = {r["term"]: r["total"] for r in model.collect()}
            assert totals == {t: v[0] for t, v in expected.items()}


def test_one_vs_rest_in_a_given_order(spark, docs):
    tags = {0: ["x"], 1: ["x"], 2: ["y"], 3: ["y"], 4: ["y"]}
    training = docs.filter("doc_id <= 4").withColumn("klasses", F.udf(lambda d: tags[d], "array<string>")("doc_id"))
    options = LearnOptions("sequential", "given")
    places = spark.createDataFrame(brute.table_places(TEXTS, {"x": [0, 1], "y": [2, 3, 4]}), "klass string, term string, place bigint")
    counts = count_terms_one_vs_rest(training)
    model = score_counts(counts, options, separate=True, places=places)
    with pytest.raises(ValueError):
        score_counts(counts, options, separate=True)
    want = brute.learn(TEXTS, {0: [0, 1], 1: [2, 3, 4]}, "sequential", brute.table_order)[0]
    assert {r["term"]: r["total"] for r in model.filter("klass = 'x'").collect()} == {t: v[0] for t, v in want.items()}


@pytest.fixture(scope="module")
def ranked(docs, labels):
    return pin(rank_features(learn(docs, labels)))


def test_posting_scores_equal_brute_force(docs, ranked):
    model = brute.learn(TEXTS, LABELS)
    for n in (1, 5, 51):
        scores = posting_scores(postings(docs), ranked.filter(f"klass = 1 and rank <= {n}"))
        got = {r["doc_id"]: r["score"] for r in scores.collect()}
        assert got == pytest.approx(brute.posting_scores(TEXTS, model[1], n), abs=1e-9)


def test_document_scores_count_every_occurrence(docs, ranked):
    model = brute.learn(TEXTS, LABELS)[1]
    best = set(brute.ranking(model)[:4])
    for n, terms in ((-1, set(model)), (0, set()), (4, best), (10_000, set(model))):
        got = {r["doc_id"]: r["score"] for r in document_scores(docs, ranked.drop("rank"), 1, n).collect()}
        want = {d: sum(model[t][1] for t in text.split(" ") if t in terms) for d, text in TEXTS.items()}
        assert got == pytest.approx(want, abs=1e-8)


def test_repeated_token_counts_once_in_postings_only(spark):
    docs = corpus_from_rows(spark, [("a", None, "aaa aaa bbb", None)])
    model = spark.createDataFrame([(0, "aaa", 1, 1.0), (0, "bbb", 2, 0.25)], "klass int, term string, rank int, log_likelihood double")
    assert posting_scores(postings(docs), model).first()["score"] == 1.25
    assert document_scores(docs, model, 0).first()["score"] == 2.25


def test_scores_of_stored_documents(docs, ranked, spark):
    ids = spark.createDataFrame([(3,), (3,), (8,)], "doc_id bigint")
    some = {r["doc_id"]: r["score"] for r in score_indexed_documents(index_view(docs), ids, ranked, 1).collect()}
    everything = {r["doc_id"]: r["score"] for r in document_scores(docs, ranked, 1).collect()}
    assert some == {d: everything[d] for d in (3, 8)}


def test_steps_snapshots_and_resumption(docs, ranked):
    features = ranked.filter("klass = 1")
    steps = stepwise_scores(postings(docs), features.filter("rank <= 9")).collect()
    last = {}
    for r in sorted(steps, key=lambda r: r["iteration"]):
        last[r["doc_id"]] = r["log_score"]
    nine = {r["doc_id"]: r["score"] for r in posting_scores(postings(docs), features.filter("rank <= 9")).collect()}
    assert last == nine

    search = StepSearch(postings(docs), ranked, 1)
    three = search.steps(None, 3)
    before = three.scores.collect()
    more = search.steps(three, 6)
    assert (three.number, more.number) == (2, 8)
    assert {r["doc_id"]: r["score"] for r in more.scores.collect()} == nine
    assert sorted(three.scores.collect()) == sorted(before)  # later steps leave it alone
    assert search.steps(more, 0) is more
    end = search.steps(more, 10_000)
    assert end.number == search.n_features - 1 and not search.has_next(end)

    resumed = resume_scores(three.scores, postings(docs), features, 2, 6)
    assert {r["doc_id"]: r["score"] for r in resumed.collect()} == nine


def test_single_steps_give_the_same_doubles_as_one_job(spark):
    rng = random.Random(4)
    terms = [f"w{i:02}" for i in range(12)]
    docs = spark.createDataFrame(
        [(t, d) for d in range(40) for t in rng.sample(terms, 7)], "term string, doc_id bigint"
    )
    features = spark.createDataFrame(
        [(0, t, i + 1, rng.uniform(-1, 1) * 10 ** rng.randint(-6, 2)) for i, t in enumerate(terms)],
        "klass int, term string, rank int, log_likelihood double",
    )
    search, at = StepSearch(docs, features, 0), None
    for _ in terms:
        at = search.step(at)
    whole = posting_scores(docs, features).select("doc_id", "score")
    assert sorted(map(tuple, at.scores.select("doc_id", "score").collect())) == sorted(
        map(tuple, whole.collect())
    )


def test_a_tiny_score_is_still_a_member(spark):
    docs = spark.createDataFrame([("www", 1), ("vvv", 1), ("vvv", 2)], "term string, doc_id bigint")
    features = spark.createDataFrame(
        [(0, "www", 1, 1.0), (0, "vvv", 2, -1.0 + 4e-10)],
        "klass int, term string, rank int, log_likelihood double",
    )
    scores = posting_scores(docs, features).withColumn("member", is_member(F.col("score")))
    found = {r["doc_id"]: (r["score"], r["member"]) for r in scores.collect()}
    assert found[1] == (pytest.approx(4e-10, rel=1e-5), True) and found[2][1] is False


def test_features_that_differ_by_less_than_rounding_keep_their_order(spark):
    model = spark.createDataFrame(
        [(0, "aaa", 2.4266e-13), (0, "zzz", 2.4267e-13), (0, "mmm", 2.4266e-13)],
        "klass int, term string, score double",
    )
    ranked = rank_features(model).orderBy("rank").collect()
    assert [r["term"] for r in ranked] == ["zzz", "aaa", "mmm"]
