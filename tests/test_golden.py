"""The eight-document corpus with known likelihoods and scores."""

import math

import pytest
from pyspark.sql import functions as F

import brute
from seedsift.operators.counts import count_terms
from seedsift.operators.learn import LearnOptions, learn, log_priors, rank_features, unseen_terms
from seedsift.operators.scoring import StepSearch, document_scores, posting_scores
from seedsift.plans.bounded import settle
from seedsift.sources.corpus import corpus_from_rows
from seedsift.sources.index import postings

TEXTS = ["aaa bbb", "aaa ccc", "ccc ddd", "aaa eee", "ccc eee", "ddd eee", "fff ggg", "ddd aaa"]
CLASSES = [1, 1, 0, 1, 0, 0, 0, 1]
GIVEN = LearnOptions(total_mode="sequential", term_order="given")


@pytest.fixture(scope="module")
def corpus(spark):
    return corpus_from_rows(spark, [(str(i), None, t, None) for i, t in enumerate(TEXTS)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(CLASSES[i], i) for i in range(4)], "klass int, doc_id bigint")


@pytest.fixture(scope="module")
def places(spark):
    """The order in which the known values came about."""
    labels = {k: [i for i in range(4) if CLASSES[i] == k] for k in (0, 1)}
    found = brute.table_places(dict(enumerate(TEXTS)), labels)
    return spark.createDataFrame(found, "klass int, term string, place bigint")


def rows(model):
    return {(r["klass"], r["term"]): r for r in model.collect()}


def test_given_order_matches_every_golden_value(corpus, labels, places):
    got = rows(learn(corpus, labels, GIVEN, places=places))
    expected = {
        (0, "ccc"): (1, 1, 1, 4, 1.098612, math.nan),
        (0, "ddd"): (1, 1, 2, 5, 0.405465, 0.013844),
        (1, "aaa"): (3, 1, 4, 6, 0.405465, 0.030575),
        (1, "ccc"): (1, 1, 3, 6, 0.0, 0.0),
        (1, "bbb"): (1, 1, 4, 7, -0.287682, 0.004143),
        (1, "eee"): (1, 1, 4, 8, 0.0, 0.0),
    }
    assert got.keys() == expected.keys()
    for key, (p, n, nc, total, ll, ig) in expected.items():
        row = got[key]
        assert (row["p"], row["n"], row["nc"], row["total"]) == (p, n, nc, total), key
        assert row["log_likelihood"] == pytest.approx(ll, abs=1e-6)
        assert row["score"] == pytest.approx(ig, abs=1e-6, nan_ok=True)
    assert got[(1, "ccc")]["log_likelihood"] == 0.0
    assert got[(1, "eee")]["log_likelihood"] == 0.0


def test_members_are_exactly_the_documents_above_zero(corpus, labels, places):
    ranked = settle(rank_features(learn(corpus, labels, GIVEN, places=places)))
    search = StepSearch(postings(corpus), ranked, 1)
    iteration = None
    while search.has_next(iteration):
        iteration = search.step(iteration)
    assert iteration.number == 3
    assert search.step(iteration) is iteration
    scores = {r["doc_id"]: r["score"] for r in iteration.scores.collect()}
    assert len(scores) > 4
    assert 6 not in scores
    for doc, score in scores.items():
        assert (score > 0) == (CLASSES[doc] == 1), doc
    assert scores == pytest.approx(
        {0: 0.117783, 1: 0.405465, 2: 0.0, 3: 0.405465, 4: 0.0, 5: 0.0, 7: 0.405465}, abs=1e-6
    )
    assert iteration.log_score(6) is None
    in_one_go = posting_scores(postings(corpus), search.features)
    assert {r["doc_id"]: r["score"] for r in in_one_go.collect()} == scores


def test_documents_without_a_feature_score_zero_token_by_token(corpus, labels, places):
    scores = document_scores(corpus, learn(corpus, labels, GIVEN, places=places), 1)
    assert {r["doc_id"]: r["score"] for r in scores.collect()}[6] == 0.0


def test_priors_carry_the_drift_of_earlier_classes(corpus, labels):
    drift = unseen_terms(count_terms(corpus, labels))
    got = {r["klass"]: r["log_prior"] for r in log_priors(labels, drift).collect()}
    assert got == pytest.approx({0: -1.098612, 1: 0.405465}, abs=1e-6)
    local = {r["klass"]: r["log_prior"] for r in log_priors(labels).collect()}
    assert local[1] == pytest.approx(1.098612, abs=1e-6)


def test_local_totals(corpus, labels):
    got = rows(learn(corpus, labels))
    lls = {t: got[(1, t)]["log_likelihood"] for t in ("aaa", "ccc", "bbb", "eee")}
    assert lls == pytest.approx(
        {"aaa": -0.287682, "ccc": -1.098612, "bbb": -1.386294, "eee": -1.386294}, abs=1e-6
    )
    assert all(math.isnan(got[(1, t)]["score"]) for t in lls)


def test_term_order_gives_other_members(corpus, labels):
    options = LearnOptions(total_mode="sequential", term_order="term")
    model = rank_features(learn(corpus, labels, options))
    scores = posting_scores(postings(corpus), model.filter(F.col("klass") == 1)).collect()
    wrong = {r["doc_id"] for r in scores if (r["score"] > 0) != (CLASSES[r["doc_id"]] == 1)}
    assert wrong == {2, 4}
