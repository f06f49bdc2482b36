import pytest
from pyspark.sql import functions as F

from seedsift.operators import labels as lb
from seedsift.operators.learn import learn, log_priors, rank_features
from seedsift.plans.search import index_corpus, search_by_example
from seedsift.sources import index as ix
from seedsift.sources.corpus import (
    corpus_from_rows,
    count_without_text,
    number_lines,
    parse_lines,
    read_corpus,
    read_lines,
    rejected_lines,
    usable,
)
from seedsift.sources.model_store import feature_trace, load_model, save_model, write_listing
from seedsift.sources.reports import write_evaluation, write_results
from seedsift.sources.seeds import parse_seeds, read_seeds

LINES = [
    "d1\tFirst\taaa bbb ccc",
    "only\ttwo",
    "d2\tSecond\taaa ddd\tx y\tz",
    "",
    "d3\t\t\t",
    "d1\tAgain\teee fff",
]


@pytest.fixture(scope="module")
def corpus_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "corpus.tsv"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(path)


def test_valid_lines(spark, corpus_path):
    rows = read_corpus(spark, corpus_path).orderBy("doc_id").collect()
    assert [(r["id"], r["title"], r["lemmas"], r["tags"]) for r in rows] == [
        ("d1", "First", "aaa bbb ccc", None),
        ("d2", "Second", "aaa ddd", "x y\tz"),
        ("d3", "", "", ""),
        ("d1", "Again", "eee fff", None),
    ]


def test_rejects_with_line_numbers(spark, corpus_path):
    rejects = rejected_lines(number_lines(read_lines(spark, corpus_path)))
    got = sorted((r["line_no"], r["raw_line"]) for r in rejects.collect())
    assert got == [(2, "only\ttwo"), (4, "")]


def test_line_numbers_run_on_over_many_splits(spark, tmp_path):
    spark.range(0, 5000, 1, 7).selectExpr("lpad(id, 6, '0') AS value").write.text(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = number_lines(read_lines(spark, str(tmp_path / "t")))
        wrong = lines.filter(F.col("value").cast("int") + 1 != F.col("line_no"))
        assert lines.count() == 5000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_without_text_are_counted_and_dropped(spark):
    docs = corpus_from_rows(spark, [("a", None, "xxx", None), ("b", None, None, None)])
    assert count_without_text(docs).first()[0] == 1
    assert [r["id"] for r in usable(docs).collect()] == ["a"]


def test_seed_list(spark, tmp_path):
    (tmp_path / "seeds").write_text("+d1\n-d2\n# note\n\n+d1\n-nowhere\n")
    seeds = read_seeds(spark, str(tmp_path / "seeds"))
    assert sorted(map(tuple, seeds.collect())) == [(0, "d1"), (1, "d2"), (1, "nowhere")]


def test_first_document_wins_and_unknown_ids_are_reported(spark):
    docs = corpus_from_rows(spark, [("d1", None, "a", None), ("d2", None, "b", None), ("d1", None, "c", None)])
    lines = spark.createDataFrame([("+d1",), ("-d2",), ("-nowhere",)], ["value"])
    seeds = parse_seeds(lines)
    assert sorted(map(tuple, lb.labels_from_seeds(docs, seeds).collect())) == [(0, 0), (1, 1)]
    assert [tuple(r) for r in lb.unknown_ids(docs, seeds).select("klass", "id").collect()] == [(1, "nowhere")]


def test_postings_tags_and_lookups(spark):
    docs = corpus_from_rows(spark, [("a", "T One", "x x yy", "p q p"), ("b", None, "yy", None)])
    index = ix.index_view(docs)
    assert sorted(map(tuple, index.text.collect())) == [("x", 0), ("yy", 0), ("yy", 1)]
    assert sorted(map(tuple, index.postings_of("title").collect())) == [("One", 0), ("T", 0)]
    assert sorted(map(tuple, index.tags.collect())) == [(0, "p"), (0, "q")]
    assert [r[0] for r in ix.documents_with_tag(index.tags, "q").collect()] == [0]
    assert [r["doc_id"] for r in ix.documents_by_id(docs, "b").collect()] == [1]
    df = {r["term"]: r["df"] for r in ix.document_frequency(index.text).collect()}
    assert df == {"x": 1, "yy": 2}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_terms_reach_the_parquet_scan_one_by_one(spark, tmp_path):
    docs = corpus_from_rows(spark, [(str(i), None, f"w{i} common", None) for i in range(50)])
    index = ix.build_index(docs, str(tmp_path / "index"))
    terms = [f"w{i}" for i in range(25)]
    few = ix.restrict_to_terms(index.text, terms)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    pushed = plan_of(few).split("PushedFilters: ")[1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert pushed.count("In(term") == 4 and "Or(Or(In(term, [w0," in pushed
    assert few.count() == 25
    picked = index.documents(index.docs.filter("doc_id in (3, 4)"))
    assert "In(doc_id, [3,4])" in plan_of(picked)
    assert picked.count() == 2


def test_a_search_reads_few_of_the_postings(spark, tmp_path):
    docs = corpus_from_rows(
        spark, [(str(i), None, " ".join(f"w{i * 40 + j:06}" for j in range(40)), None) for i in range(1500)]
    )
    index = ix.build_index(docs.coalesce(1), str(tmp_path / "index"))
    few = ix.restrict_to_terms(index.text, [f"w{i:06}" for i in range(0, 60_000, 4_000)])
    assert few.count() == 15
    assert rows_scanned(few) < index.text.count() * 0.6


def rows_scanned(df):
    df = df.groupBy().count()
    df.collect()
    plans, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
        elif "Scan" in plan.nodeName():
            rows += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return rows


def test_index_replaces_an_existing_one(spark, tmp_path):
    path = str(tmp_path / "index")
    ix.build_index(corpus_from_rows(spark, [("a", None, "one", None)]), path)
    index = ix.build_index(corpus_from_rows(spark, [("b", None, "two", None)]), path)
    assert [r["term"] for r in index.text.collect()] == ["two"]


def test_index_search_and_reports_end_to_end(spark, tmp_path):
    texts = ["red wine glass", "red wine bottle", "blue sky cloud", "blue sea wave", "red wine grape", "blue sky bird", "green hill"]
    lines = [f"n{i}\tTitle {i}\t{t}" for i, t in enumerate(texts)] + ["broken"]
    (tmp_path / "c.tsv").write_text("\n".join(lines))
    index, rejects = index_corpus(spark, str(tmp_path / "c.tsv"), str(tmp_path / "index"))
    assert [(r["line_no"], r["raw_line"]) for r in rejects.collect()] == [(8, "broken")]
    seeds = parse_seeds(spark.createDataFrame([("+n0",), ("+n1",), ("-n2",), ("-n3",)], ["value"]))
    results = search_by_example(index, seeds)
    rows = results.collect()
    assert [r["id"] for r in rows] == ["n4"]  # n5 and n6 share no term with the + seeds
    write_results(results, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()["value"].split("\t")
    assert line[1:] == ["n4", "Title 4", "red wine grape"] and float(line[0]) == rows[0]["score"]


def test_model_round_trip_and_listing(spark, tmp_path):
    docs = corpus_from_rows(spark, [("a", None, "one two two", None), ("b", None, "two six", None)])
    labels = spark.createDataFrame([(0, 0), (1, 1)], "klass int, doc_id bigint")
    ranked = rank_features(learn(docs, labels))
    save_model(ranked, log_priors(labels), str(tmp_path / "model"))
    terms, priors = load_model(spark, str(tmp_path / "model"))
    assert sorted(map(str, terms.collect())) == sorted(map(str, ranked.select(terms.columns).collect()))
    assert priors.count() == 2
    trace = feature_trace(terms, 0, 1).collect()
    assert len(trace) == 1 and trace[0]["iteration"] == 0
    write_listing(terms, str(tmp_path / "listing"))
    listed = [r["value"] for r in spark.read.text(str(tmp_path / "listing")).collect()]
    assert len(listed) == 2 * terms.count() and any(x.startswith("0: two/") for x in listed)


def test_evaluation_lines(spark, tmp_path):
    frame = spark.createDataFrame([("corn", 3, 1, 2, 0.5, 0.25, 1.0)], "klass string, n_train int, n_pos int, n_neg int, p double, r double, f1 double")
    write_evaluation(frame, str(tmp_path / "eval"))
    assert spark.read.text(str(tmp_path / "eval")).first()["value"] == "corn 3 1 2 0.5 0.25 1.0"


def test_the_first_document_is_that_of_the_first_file(spark, tmp_path):
    """Spark packs the larger file first; the order of the files must not follow that."""
    (tmp_path / "a.tsv").write_text("x\tfrom a\tone\n")
    rows = ["x\tfrom b\ttwo", "bad line", *(f"y{i}\tt\tlong text {i}" for i in range(50))]
    (tmp_path / "b.tsv").write_text("\n".join(rows) + "\n")
    docs = read_corpus(spark, str(tmp_path))
    found = {r["id"]: r["doc_id"] for r in docs.orderBy(F.desc("doc_id")).collect()}
    assert found["x"] == 0 and found["y0"] == 3
    wanted = spark.createDataFrame([("x",)], "id string")
    assert lb.resolve_ids(docs, wanted).first()["doc_id"] == 0
    assert docs.filter("id = 'x' AND doc_id = 0").first()["title"] == "from a"


def test_nothing_of_a_long_text_is_lost(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(10_001)) + " " + "z" * 300
    tags = " ".join(f"t{i}" for i in range(10_001))
    docs = corpus_from_rows(spark, [("a", "title", words, tags)])
    index = ix.build_index(docs, str(tmp_path / "whole"))
    assert index.text.count() == 10_002 and index.tags.count() == 10_001
    assert index.text.filter(F.length("term") == 300).count() == 1
    limited = ix.build_index(docs, str(tmp_path / "limited"), max_tokens=10_000, max_word=255)
    assert limited.text.count() == 10_000 and limited.tags.count() == 10_000
