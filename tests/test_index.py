"""Lookups in a stored index: the right rows, and few besides."""

import contextlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import brute
from seedsift.functions.exact import exact_sum
from seedsift.operators import evaluate as ev
from seedsift.operators import labels as lb
from seedsift.operators.counts import count_indexed_terms, count_terms
from seedsift.operators.learn import learn
from seedsift.operators.scoring import (
    document_scores,
    posting_hits,
    posting_scores,
    score_indexed_documents,
)
from seedsift.plans import experiment as ex
from seedsift.sources import index as ix
from seedsift.sources import pruned
from seedsift.sources.corpus import corpus_from_rows, number_lines, read_lines
from seedsift.sources.pruned import reach
from test_experiment import IDS, TAGS, TEXTS
from test_sources import plan_of, rows_scanned

N_DOCS = 6000


@contextlib.contextmanager
def settings(spark, **values):
    names = {name.replace("_", "."): value for name, value in values.items()}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def docs(spark):
    """Every document has "common", eight terms of a large vocabulary and two of its own."""
    draw = random.Random(3)
    rows = []
    for i in range(N_DOCS):
        words = [f"w{draw.randrange(20_000):05}" for _ in range(8)]
        rows.append((f"n{i // 2}", f"Title {i}", " ".join(["common", *words, words[0], f"own{i:05}x"]), "tag"))
    return corpus_from_rows(spark, rows).repartition(6)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    many_parts = {"spark_sql_shuffle_partitions": "16", "spark_sql_adaptive_coalescePartitions_enabled": "false"}
    with pytest.MonkeyPatch.context() as patch, settings(spark, **many_parts):
        patch.setattr(pruned, "PAGE_ROWS", 64)
        return ix.build_index(docs, str(tmp_path_factory.mktemp("index")))


def part_filter(plan):
    return re.search(r"PartitionFilters: \[[^\]]*part#\d+ IN|PartitionFilters: \[[^\]]*\(part#\d+ = ", plan)


def features(spark, terms):
    rows = [(0, t, i + 1, 0.01 * (i % 7) - 0.02) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "klass int, term string, rank int, log_likelihood double")


def words(n, seed):
    return sorted({f"w{random.Random(seed + i).randrange(20_000):05}" for i in range(n)})


def test_tables_of_an_index(spark, docs, index):
    assert index.docs.count() == N_DOCS
    assert index.text.count() == ix.postings(docs).count()
    parts = index.stored.text.rows.groupBy("part").agg(
        F.min("term").alias("lo"), F.max("term").alias("hi")
    )
    bounds = sorted((r["lo"], r["hi"]) for r in parts.collect())
    assert len(bounds) > 10 and all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    assert index.stored.text.rows.filter("term = 'common'").select("part").distinct().count() > 1
    df = {r["term"]: r["df"] for r in index.stored.text.document_frequency().collect()}
    want = {r["term"]: r["df"] for r in ix.document_frequency(ix.postings(docs)).collect()}
    assert df == want
    bounds = sorted((r["lo"], r["hi"]) for r in index.stored.docs.bounds.collect())
    assert len(bounds) > 5 and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


@pytest.mark.parametrize("n", [10, 51, 5000])
def test_a_search_opens_the_parts_of_its_terms(spark, docs, index, n):
    wanted = words(n, n)
    some = features(spark, wanted)
    hits = posting_hits(index.searchable(), some)
    want = ix.postings(docs).join(some, "term")
    assert sorted(map(tuple, hits.select("term", "doc_id", "rank").collect())) == sorted(
        map(tuple, want.select("term", "doc_id", "rank").collect())
    )
    plan = plan_of(hits)
    assert part_filter(plan)
    read = rows_scanned(index.stored.text.near(some))
    total = index.text.count()
    if n <= 51:
        assert read < 0.05 * total * max(1, n / 10)
        opened = index.stored.text.reach(some.select("term").distinct())
        assert len(opened.ranges) >= 0.8 * len(wanted)
        assert set(opened.parts) < {r["part"] for r in index.stored.text.rows.select("part").distinct().collect()} or n == 51
    # The vocabulary lies apart from "common", whose postings are never read.
    assert read <= total - N_DOCS


def test_a_hot_term_is_read_from_all_its_parts(spark, docs, index):
    hits = posting_hits(index.searchable(), features(spark, ["common", "no such term"]))
    assert hits.count() == N_DOCS
    got = posting_scores(index.searchable(), features(spark, ["common", "w00001"]))
    want = posting_scores(ix.postings(docs), features(spark, ["common", "w00001"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nothing_wanted_reads_nothing(spark, index):
    none = features(spark, [])
    assert posting_hits(index.searchable(), none).count() == 0
    assert index.documents(index.docs.limit(0)).count() == 0
    assert index.term_counts(index.docs.limit(0)).count() == 0
    assert index.numbers(index.docs.select("id").limit(0)).count() == 0


@pytest.mark.parametrize("n", [8, 700, N_DOCS])
def test_documents_by_number(spark, docs, index, n):
    ids = random.Random(n).sample(range(N_DOCS), n) + [10**9, -5]
    wanted = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").union(
        spark.sql("SELECT CAST(NULL AS BIGINT)")
    )
    got = index.documents(wanted)
    assert {r["doc_id"] for r in got.collect()} == set(ids) - {10**9, -5}
    assert got.count() == n and part_filter(plan_of(got))
    if n == 8:
        assert rows_scanned(index.stored.docs.select(wanted)) < 0.5 * N_DOCS
    counts = index.term_counts(wanted)
    want = ix.forward_rows(docs.select("doc_id", "lemmas")).join(wanted, "doc_id")
    assert sorted(map(tuple, counts.select("doc_id", "term", "tf").collect())) == sorted(
        map(tuple, want.select("doc_id", "term", "tf").collect())
    )


@pytest.mark.parametrize("n", [8, 5000])
def test_learning_reads_what_is_labelled(spark, docs, index, n):
    ids = random.Random(n).sample(range(N_DOCS), n)
    labels = spark.createDataFrame([(i % 2, d) for i, d in enumerate(ids)], "klass int, doc_id bigint")
    got = count_indexed_terms(index, labels)
    want = count_terms(docs, labels).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    forward = index.stored.forward
    assert part_filter(plan_of(forward.select(labels)))
    if n == 8:
        assert rows_scanned(forward.select(labels)) < 0.5 * forward.rows.count()


def test_the_first_document_of_an_id_by_its_bucket(spark, docs, index):
    wanted = spark.createDataFrame([("n0",), ("n7",), ("n7",), ("nowhere",)], "id string")
    got = sorted(map(tuple, lb.resolve_ids(index, wanted).collect()))
    assert got == sorted(map(tuple, lb.resolve_ids(docs, wanted).collect()))
    assert [r["id"] for r in lb.unknown_ids(index, wanted).collect()] == ["nowhere"]


def test_an_index_that_is_opened_again(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    built = ix.build_index(docs.filter("doc_id < 200"), path)
    again = ix.open_index(spark, path)
    wanted = docs.select("doc_id", "id").filter("doc_id BETWEEN 20 AND 30")
    for a, b in (
        (built.docs, again.docs),
        (built.text, again.text),
        (built.title, again.title),
        (built.tags, again.tags),
        (built.documents(wanted), again.documents(wanted)),
        (built.term_counts(wanted), again.term_counts(wanted)),
        (built.numbers(wanted), again.numbers(wanted)),
    ):
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(
            map(str, b.select(sorted(b.columns)).collect())
        )


def test_an_index_of_nothing(spark, docs, tmp_path):
    index = ix.build_index(docs.limit(0), str(tmp_path / "index"))
    assert index.docs.count() == 0 and index.text.count() == 0
    wanted = spark.createDataFrame([(1, "n0")], "doc_id bigint, id string")
    assert index.documents(wanted).count() == 0 and index.numbers(wanted).count() == 0
    assert posting_hits(index.searchable(), features(spark, ["common"])).count() == 0


def test_scores_of_stored_documents(spark, docs, index):
    labels = spark.createDataFrame([(i % 2, i) for i in range(40)], "klass int, doc_id bigint")
    model = learn(docs, labels)
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 100)] + [(10**9,)], "doc_id bigint")
    got = score_indexed_documents(index, ids, model, 0)
    want = document_scores(docs.join(ids, "doc_id", "left_semi"), model, 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    view = score_indexed_documents(ix.index_view(docs), ids, model, 0)
    assert sorted(map(tuple, view.collect())) == sorted(map(tuple, want.collect()))


def test_forward_rows_count_every_long_term(spark):
    docs = corpus_from_rows(
        spark,
        [("a", None, "one one  two ab one two", None), ("b", None, "", None), ("c", None, None, None), ("d", None, "x" * 5, None)],
    )
    got = sorted(map(tuple, ix.forward_rows(docs.select("doc_id", "lemmas")).collect()))
    assert got == [(0, "one", 3), (0, "two", 2), (3, "xxxxx", 1)]


def test_reach_covers_all_keys_with_few_ranges(spark):
    keys = spark.range(0, 3000, 3).selectExpr("id AS k", "CAST(id % 5 AS INT) AS part")
    found = reach(keys, "part", "k", ranges=8)
    assert found.parts == [0, 1, 2, 3, 4] and len(found.ranges) <= 8
    assert all(any(lo <= k <= hi for lo, hi in found.ranges) for k in range(0, 3000, 3))
    few = reach(keys.filter("k < 9"), "part", "k")
    assert few.ranges == [(0, 0), (3, 3), (6, 6)]


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(1)
    values = [rng.uniform(-9, 9) for _ in range(2000)] + [0.0, -0.0, 1e-12, 1e9, -1e9]
    rows = [(i % 3, v) for i, v in enumerate(values)] + [(5, None), (6, math.inf), (6, 1.0), (7, math.nan), (8, math.inf), (8, -math.inf)]
    frame = spark.createDataFrame(rows, "k int, v double")
    sums = [
        {r["k"]: r["s"] for r in frame.repartition(n).groupBy("k").agg(exact_sum("v").alias("s")).collect()}
        for n in (1, 3, 7)
    ]
    for k in range(3):
        assert sums[0][k] == sums[1][k] == sums[2][k]
        assert sums[0][k] == pytest.approx(math.fsum(v for i, v in enumerate(values) if i % 3 == k), abs=1e-9)
    assert sums[0][5] == 0.0 and sums[0][6] == math.inf
    assert math.isnan(sums[0][7]) and math.isnan(sums[0][8])
    times = frame.filter("k < 3").groupBy("k").agg(exact_sum("v", "2").alias("s")).collect()
    assert {r["k"]: r["s"] for r in times} == {k: 2 * sums[0][k] for k in range(3)}


def test_lines_do_not_move_to_be_numbered(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.tsv").write_text("".join(f"{name}{i}\tt\ttext {i}\n" for i in range(300)))
    with settings(spark, spark_sql_files_maxPartitionBytes="700"):
        numbered = number_lines(read_lines(spark, str(tmp_path)))
        assert "Exchange hashpartitioning" not in plan_of(numbered)
        assert "SortMergeJoin" not in plan_of(numbered)
        rows = sorted((r["line_no"], r["value"].split("\t")[0]) for r in numbered.collect())
    assert rows == [(i + 1, f"{'ab'[i // 300]}{i % 300}") for i in range(600)]


def test_break_even_by_selection_in_long_lists_with_ties(spark):
    rng = random.Random(17)
    rows, sizes, want = [], [], {}
    for k, n in enumerate([1, 3, 40, 400, 900, 2500, 2500, 2500]):
        steps = (n, 4, 10**9, 30, 10**9, 1, 50, 10**9)[k]
        listed = [(float(rng.randrange(steps)), f"d{i:05}", rng.random() < 0.1 * k) for i in range(n)]
        if k == 6:  # the first right one comes late
            listed = [(s, i, s < 3) for s, i, _ in listed]
        rows += [(f"k{k}", i, s, g) for s, i, g in listed]
        golds = [g for _, _, g in sorted(listed, key=lambda x: (-x[0], x[1]))]
        n_gold = sum(golds) + (7 if k % 2 else 0)
        sizes.append((f"k{k}", n_gold))
        want[f"k{k}"] = brute.break_even(golds, n_gold)
    rows.append(("nan", "a", math.nan, True))
    rows.append(("nan", "b", 1.0, False))
    sizes.append(("nan", 1))
    want["nan"] = (1.0, 1.0, 1.0)
    ranked = spark.createDataFrame(rows, "klass string, id string, score double, gold boolean")
    got = ev.break_even(ranked.repartition(5), spark.createDataFrame(sizes, "klass string, n_gold bigint"))
    for r in got.collect():
        assert (r["p"], r["r"], r["f1"]) == pytest.approx(want[r["klass"]], nan_ok=True), r["klass"]


@pytest.mark.parametrize("stored", [False, True])
def test_a_pool_is_labelled_for_all_its_tags(spark, tmp_path, stored):
    """What every class has labelled, and own examples besides, against one class after another."""
    tagged = corpus_from_rows(spark, [(IDS[d], None, TEXTS[d], " ".join(TAGS[d]) or None) for d in TEXTS])
    pool = [0, 1, 2, 3, 5, 8]
    seeds = {"x": {9: "x" in TAGS[9], 10: "x" in TAGS[10]}, "y": {}, "z": {}}
    frame = spark.createDataFrame(
        [(k, d, g) for k, s in seeds.items() for d, g in s.items()], "klass string, doc_id bigint, gold boolean"
    )
    source = ix.build_index(tagged, str(tmp_path / "index")) if stored else tagged
    postings = source.searchable() if stored else ix.postings(tagged)
    rounds = ex.active_learning(
        source,
        postings,
        frame,
        ex.ExperimentOptions(n_features=10),
        batch="double",
        pool=spark.createDataFrame([(d,) for d in pool], "doc_id bigint"),
    )
    got = {}
    for r in sorted(rounds.collect(), key=lambda r: r["round"]):
        got.setdefault(r["klass"], []).append((r["n_train"], r["n_pos"], r["n_neg"], r["p"], r["r"], r["f1"]))
    assert set(got) == {t for d in pool for t in TAGS[d]} | {"x"}
    for klass in got:
        gold = {d: klass in TAGS[d] for d in TEXTS}
        seed = {d: gold[d] for d in pool} | seeds[klass]
        want = brute.active_learning(TEXTS, IDS, gold, seed, 10, lambda s: -s, "double")
        assert len(got[klass]) == len(want) > 1
        for a, b in zip(got[klass], want):
            assert a == pytest.approx(b, nan_ok=True)
