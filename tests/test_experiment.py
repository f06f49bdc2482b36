import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from seedsift.operators import evaluate as ev
from seedsift.operators import labels as lb
from seedsift.operators.ranking import full_ranking, next_example, result_order, top_documents
from seedsift.plans import experiment as ex
from seedsift.sources.corpus import corpus_from_rows
from seedsift.sources.index import postings
from test_learning import random_texts

RANKED = "klass string, id string, score double, gold boolean"
SIZES = "klass string, n_gold bigint"


def test_break_even_example_and_edges(spark):
    rows = [("a", "t1", 3.0, True), ("a", "t2", 2.0, False), ("a", "t3", 1.0, True), ("b", "t1", 1.0, False)]
    sizes = [("a", 2), ("b", 1), ("c", 4), ("d", 0)]
    got = {
        r["klass"]: (r["position"], r["p"], r["r"], r["f1"])
        for r in ev.break_even(spark.createDataFrame(rows, RANKED), spark.createDataFrame(sizes, SIZES)).collect()
    }
    assert got["a"] == (2, 0.5, 0.5, 0.5)
    assert got["b"][:3] == (1, 0.0, 0.0) and math.isnan(got["b"][3])  # nothing right
    assert math.isnan(got["c"][1]) and got["c"][2] == 0.0  # nothing retrieved
    assert math.isnan(got["d"][1]) and math.isnan(got["d"][2])  # nothing to find


def test_break_even_equals_the_walk_along_the_list(spark):
    rng = random.Random(11)
    rows, sizes, want = [], [], {}
    for k in range(60):
        golds = [rng.random() < 0.4 for _ in range(rng.randint(1, 12))]
        n_gold = sum(golds) + rng.randint(0, 5)
        rows += [(f"k{k}", f"d{i:02}", -float(i), g) for i, g in enumerate(golds)]
        sizes.append((f"k{k}", n_gold))
        want[f"k{k}"] = brute.break_even(golds, n_gold)
    ranked, sizes = spark.createDataFrame(rows, RANKED), spark.createDataFrame(sizes, SIZES)
    for r in ev.break_even(ranked, sizes).collect():
        assert (r["p"], r["r"], r["f1"]) == pytest.approx(want[r["klass"]], nan_ok=True), r["klass"]
    curve = ev.precision_recall_curve(ranked, sizes)
    assert curve.count() == len(rows)
    counts = {r["klass"]: r for r in ev.confusion(ranked).collect()}
    ends = {r["klass"]: r["tp"] for r in curve.groupBy("klass").agg(F.max("tp").alias("tp")).collect()}
    assert {k: r["tp"] for k, r in counts.items()} == ends


def test_top_documents_and_orders(spark):
    scores = spark.createDataFrame([(i, str(i), float(i // 2)) for i in range(10)], "doc_id bigint, id string, score double")
    top = top_documents(scores, 3)
    assert [r["doc_id"] for r in top.orderBy(*result_order()).collect()] == [8, 9, 6]
    assert [r["doc_id"] for r in top.orderBy(*result_order(worst_first=True)).collect()] == [6, 9, 8]
    assert [r["id"] for r in full_ranking(scores).take(3)] == ["8", "9", "6"]


def test_next_example_strategies(spark):
    rows = [("a", 3.0), ("b", -0.5), ("c", 1.0)]
    candidates = spark.createDataFrame(rows, "id string, score double")
    assert next_example(candidates).first()["id"] == "a"
    assert next_example(candidates, "uncertain").first()["id"] == "b"
    first = next_example(candidates, "random", 1).first()["id"]
    assert first == next_example(candidates.repartition(3), "random", 1).first()["id"]


def test_label_sets(spark):
    training = spark.createDataFrame([(i,) for i in range(5)], "doc_id bigint")
    pos = spark.createDataFrame([(1,), (3,)], "doc_id bigint")
    assert sorted(r[0] for r in lb.complement(training, pos).collect()) == [0, 2, 4]
    a = spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "klass int, doc_id bigint")
    assert lb.union_labels(a, a).count() == 2
    scores = spark.createDataFrame([(1, 0.5), (9, 0.1)], "doc_id bigint, score double")
    assert [r["doc_id"] for r in lb.without_labelled(scores, a).collect()] == [9]
    flags = lb.with_gold_flag(scores, a.select("doc_id"), ["doc_id"]).collect()
    assert {r["doc_id"]: r["gold"] for r in flags} == {1: True, 9: False}


TEXTS = random_texts(60, 21)
RNG = random.Random(4)
IDS = {d: ("training/" if d < 35 else "test/") + f"{d:03}" for d in TEXTS}
TAGS = {d: sorted({t for t in "xyz" if RNG.random() < 0.4}) for d in TEXTS}


@pytest.fixture(scope="module")
def tagged(spark):
    return corpus_from_rows(spark, [(IDS[d], None, TEXTS[d], " ".join(TAGS[d]) or None) for d in TEXTS])


def test_one_vs_rest_equals_brute_force(tagged):
    report = {r["klass"]: r for r in ex.one_vs_rest(tagged, postings(tagged), ex.ExperimentOptions(n_features=8)).collect()}
    assert set(report) == set("xyz")
    for klass, row in report.items():
        gold = {d: klass in TAGS[d] for d in TEXTS}
        train = [d for d in TEXTS if IDS[d].startswith("training/")]
        classes = {0: [d for d in train if gold[d]], 1: [d for d in train if not gold[d]]}
        scores = brute.posting_scores(TEXTS, brute.learn(TEXTS, classes)[0], 8)
        tests = sorted((d for d in scores if IDS[d].startswith("test/")), key=lambda d: (-scores[d], IDS[d]))
        n_gold = sum(gold[d] for d in TEXTS if IDS[d].startswith("test/"))
        want = brute.break_even([gold[d] for d in tests], n_gold)
        assert (row["n_train"], row["n_pos"], row["n_neg"]) == (35, len(classes[0]), len(classes[1]))
        assert (row["p"], row["r"], row["f1"]) == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize(
    "batch, strategy, key",
    [("double", "top", lambda s: -s), (9, "uncertain", abs)],
)
def test_active_learning_equals_brute_force(spark, tagged, batch, strategy, key):
    seeds = {k: {d: k in TAGS[d] for d in range(6)} for k in "xy"}
    frame = spark.createDataFrame([(k, d, g) for k, s in seeds.items() for d, g in s.items()], "klass string, doc_id bigint, gold boolean")
    rounds = ex.active_learning(tagged, postings(tagged), frame, ex.ExperimentOptions(n_features=10), strategy, batch)
    got = {}
    for r in sorted(rounds.collect(), key=lambda r: r["round"]):
        got.setdefault(r["klass"], []).append((r["n_train"], r["n_pos"], r["n_neg"], r["p"], r["r"], r["f1"]))
    for klass, seed in seeds.items():
        gold = {d: klass in TAGS[d] for d in TEXTS}
        want = brute.active_learning(TEXTS, IDS, gold, seed, 10, key, batch)
        assert len(got[klass]) == len(want) > 1
        for a, b in zip(got[klass], want):
            assert a == pytest.approx(b, nan_ok=True)


def test_a_fully_labelled_training_set_takes_one_round(spark, tagged):
    frame = spark.createDataFrame([("x", d, "x" in TAGS[d]) for d in range(35)], "klass string, doc_id bigint, gold boolean")
    rounds = ex.active_learning(tagged, postings(tagged), frame, ex.ExperimentOptions(n_features=8)).collect()
    once = ex.one_vs_rest(tagged, postings(tagged), ex.ExperimentOptions(n_features=8)).filter("klass = 'x'").first()
    assert len(rounds) == 1
    assert [rounds[0][c] for c in ("n_train", "n_pos", "p", "r", "f1")] == [once[c] for c in ("n_train", "n_pos", "p", "r", "f1")]


def test_train_and_score_a_collection(spark, tagged):
    pos = tagged.filter("doc_id < 5").select("id")
    neg = tagged.filter("doc_id between 5 and 12").select("id")
    scored = ex.score_collection(tagged, postings(tagged), ex.train(tagged, pos, neg), 6)
    model = brute.learn(TEXTS, {0: range(5), 1: range(5, 13)})[0]
    want = {IDS[d]: s for d, s in brute.posting_scores(TEXTS, model, 6).items()}
    assert {r["id"]: r["score"] for r in scored.collect()} == pytest.approx(want, abs=1e-9)
