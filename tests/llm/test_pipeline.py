from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from seedsift.llm.catalogue import QUERIES
from seedsift.llm.simhash import fingerprints

from .data import documents, empty, prose, rows
from .test_models import junk


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality",
        "exact dedup",
        "near dedup",
        "mixing",
        "bpe",
    ]
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def write(spark, docs, path):
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 0), 0) for i in range(400)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet"
    )


def test_pipeline_keeps_clean_documents_once(spark, tmp_path):
    some = [(i, (junk if i % 5 == 0 else prose)(i, 90 + i % 50), "en", "ab"[i % 2]) for i in range(400)]
    some += [(1000 + i, some[1][1], "en", "a") for i in range(5)]
    some += [(1100, some[2][1].replace(" ", "  "), "en", "b")]
    write(spark, documents(spark, some), str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = {r.doc_id for r in got}
    clean = {i for i in range(400) if i % 5}
    assert len(found & clean) >= 0.97 * len(clean) and len(found & set(range(0, 400, 5))) <= 4
    # The longer spelling of a text stays; of equal ones the smallest id.
    assert 1 in found and not found & set(range(1000, 1005)) and 1100 in found and 2 not in found
    assert all(n <= 2 for n in Counter(r.doc_id for r in got).values())


def test_stages_keep_repeated_rows_apart(spark, tmp_path):
    docs = documents(spark)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    exact = corpus_pipeline.exact(spark, docs, "")
    assert exact.columns == docs.columns
    plain = {"".join((t or "").split()) for _, t, *_ in rows()}
    assert exact.count() == len(plain)
    near = corpus_pipeline.near(spark, docs, "")
    assert near.columns == docs.columns
    kept = [(r.text or "").encode() for r in near.select("text").collect()]
    prints = fingerprints(kept).tolist()
    for i, a in enumerate(prints):
        assert all((a ^ b).bit_count() > 2 for b in prints[:i])
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    nothing = empty(spark)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mix):
        assert stage(spark, nothing, "").count() == 0
    assert corpus_pipeline.encode(spark, docs, "").count() == len(rows())
    assert near.filter(F.col("_row") != "clash").count() == 0


def test_quality_stage_on_awkward_and_empty_tables(spark, tmp_path):
    labels = [(i, i % 2, 0) for i in range(20, 50)] + [(None, 1, 0), (21, None, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    docs = documents(spark).withColumn("_pipeline_row", F.lit("theirs"))
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    # Rows with equal texts stay or go together.
    texts = Counter(repr(r.text) for r in docs.collect())
    for text, n in Counter(repr(r.text) for r in kept.collect()).items():
        assert n == texts[text]
    assert corpus_pipeline.quality(spark, empty(spark), str(tmp_path)).count() == 0
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        left = stage(spark, docs, "")
        assert left.columns == docs.columns and left.filter("_pipeline_row <> 'theirs'").count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, empty(spark), str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
