from pathlib import Path

from seedsift.operators.learn import learn
from seedsift.operators.scoring import document_scores
from seedsift.sources.corpus import corpus_from_rows
from seedsift.streaming.scoring import score_stream


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    docs = corpus_from_rows(spark, [(str(i), None, f"one two{i % 3} three{i % 4}", None) for i in range(30)])
    labels = spark.createDataFrame([(0, 0), (0, 3), (1, 1), (1, 2)], "klass int, doc_id bigint")
    model = learn(docs, labels)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scratch = Path(spark.conf.get("spark.checkpoint.dir")) / "seedsift"
    before = set(scratch.glob("*"))
    query = score_stream(stream, model, 0, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    assert len(set(scratch.glob("*")) - before) == 1  # one table of weights for three batches
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 3
    want = {(r["doc_id"], r["score"]) for r in document_scores(docs, model, 0).collect()}
    assert {(r["doc_id"], r["score"]) for r in got.collect()} == want
    assert all(r["is_member"] == (r["score"] > 0) for r in got.collect())
