"""The paths taken when data is too large for the simple plan, on small data."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seedsift.operators.scoring import document_scores
from seedsift.plans import bounded
from seedsift.plans.prefix import prefix_sums, ranks
from seedsift.sources.corpus import corpus_from_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has one key."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(200)}", i, rng.random()) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, i int, x double").repartition(8)


def test_prefix_sums_equal_a_window(spark, skewed):
    got = prefix_sums(skewed, ["k"], [F.col("x").desc(), F.col("i")], {"n": F.lit(1).cast("bigint"), "s": F.col("i")})
    w = Window.partitionBy("k").orderBy(F.col("x").desc(), "i").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s", F.sum("i").over(w))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_large_group_is_spread_over_several_ranges(spark, skewed):
    ordered = [F.col("x"), F.col("i")]
    ranged = skewed.repartitionByRange(6, "k", *ordered).withColumn("part", F.spark_partition_id())
    assert ranged.filter("k = 'hot'").select("part").distinct().count() > 1
    assert ranks(skewed, ["k"], ordered, "r").filter("k = 'hot'").agg(F.max("r")).first()[0] == 1000


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("max_rows, max_bytes", [(1000, 1 << 20), (0, 1 << 20), (0, 0), (5, 0)])
def test_keyed_join_gives_the_same_rows_on_every_path(spark, skewed, how, max_rows, max_bytes):
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 150)], "k string, y int")
    got = bounded.keyed_join(skewed, small, ["k"], how, max_rows, max_bytes, hot_share=50)
    want = skewed.join(small, ["k"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_hot_keys_are_few_by_construction(spark, skewed):
    hot = skewed.groupBy("k").count().filter(F.col("count") > 3000 / 50)
    assert [r["k"] for r in hot.collect()] == ["hot"]


def test_document_scores_agree_when_the_model_is_too_large_to_broadcast(spark):
    docs = corpus_from_rows(spark, [(str(i), None, "the the " + f"w{i % 7}x " * (i % 3), None) for i in range(60)] + [("e", None, "", None)])
    model = spark.createDataFrame([(0, "the", 0.5)] + [(0, f"w{i}x", -0.1 * i) for i in range(5)], "klass int, term string, log_likelihood double")
    plain = document_scores(docs, model, 0)
    split = document_scores(docs, model, 0, max_bytes=0, hot_share=10)
    got = {r["doc_id"]: r["score"] for r in plain.collect()}
    assert got == {r["doc_id"]: r["score"] for r in split.collect()}
    assert got[60] == 0.0 and got[0] == 1.0 and len(got) == 61


def test_settle_and_pin_keep_rows_and_schema(spark, skewed):
    for frame in (bounded.settle(skewed), bounded.pin(skewed), bounded.pin(skewed, limit=10)):
        assert frame.dtypes == skewed.dtypes
        assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, skewed.collect()))


def test_fetch_stops_at_the_limit(spark):
    assert bounded.fetch_bounded(spark.range(11), 10) is None
    assert bounded.fetch_bounded(spark.range(10), 10).num_rows == 10


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        bounded.shared_dir(Session())
