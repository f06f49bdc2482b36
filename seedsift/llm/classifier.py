"""Document quality from random-indexing word vectors and a two-layer network.

The vectors are learned from all documents: a word's vector is the sum of its neighbours' fixed
random vectors. Words share a fixed number of hashed rows, so the table, and with it the broadcast,
is as large for a petabyte as for a megabyte. A document is the mean and spread of its words'
vectors; the network is trained on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.llm import network, wordvectors
from seedsift.llm.blocks import collected, summed
from seedsift.llm.common import byte_chunks, hash_sample, map_batches, text_bytes

MAX_TRAINING_ROWS = 20_000
CHUNK = 1 << 20
SAMPLE_SEED = 3
THRESHOLD = 0.7
TABLE = (1 << wordvectors.BUCKETS_LOG2, wordvectors.DIMS)


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row belongs to the fold that is never learned from; NULL ids do not."""
    check = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(check % folds == fold, F.lit(False))


def _chunks(batch: pa.RecordBatch, column: str = "text"):
    texts = text_bytes(batch.column(column))
    for i, j in byte_chunks(texts, CHUNK):
        part = texts[i:j]
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset :][: j - i + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        yield i, j, *wordvectors.words(data, offsets[1:] - offsets[0])


def learn_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of all hashed rows, learned from every row of ``docs``."""

    def add(total, batches):
        index, table = wordvectors.index_vectors(), total.reshape(TABLE)
        for batch in batches:
            for _, _, bucket, text in _chunks(batch):
                wordvectors.add_contexts(table, index, bucket, text)

    size = TABLE[0] * TABLE[1]
    blocks = summed(docs.select(F.col(text_col).alias("text")), size, add)
    return wordvectors.unit_rows(collected(blocks, size).reshape(TABLE))


def _pooled_batch(vectors: np.ndarray, batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
    parts = [
        wordvectors.pooled(vectors, bucket, text, j - i)
        for i, j, bucket, text in _chunks(batch, column)
    ]
    return np.concatenate(parts) if parts else np.zeros((0, wordvectors.POOLED), np.float32)


class QualityModel:
    """Word vectors and network; both of bounded size, sent to the executors once."""

    def __init__(self, vectors: np.ndarray, net: network.Network):
        self.vectors, self.net = vectors, net

    def scores(self, batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
        return self.net.scores(_pooled_batch(self.vectors, batch, column))


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_training_rows: int = MAX_TRAINING_ROWS,
) -> QualityModel:
    """Learns from at most ``max_training_rows`` labelled documents outside the held-out fold,
    chosen by a seeded hash of their id. Rows with NULL id or label teach nothing; of several
    labels of one id the lowest counts, of several texts of one id any one."""
    spark = docs.sparkSession
    vectors = learn_vectors(docs, text_col)
    shared = spark.sparkContext.broadcast(vectors)
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id IS NOT NULL AND y IS NOT NULL")
        .filter(~held_out("id"))
        .groupBy("id")
        .agg(F.min("y").alias("y"))
    )
    chosen = spark.createDataFrame(
        hash_sample(sample, "id", max_training_rows, SAMPLE_SEED), sample.schema
    )

    def pool(batches):
        for batch in batches:
            x = _pooled_batch(shared.value, batch)
            flat = pa.array(x.ravel(), pa.float32())
            offsets = pa.array(np.arange(len(x) + 1) * wordvectors.POOLED, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.ListArray.from_arrays(offsets, flat)],
                ["id", "y", "x"],
            )

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(sample.dtypes)["id"]
    # At most ``max_training_rows`` ids, each with one label and, after the last step, one text.
    rows = map_batches(
        given.join(F.broadcast(chosen), "id").select("id", "y", "text"),
        pool,
        f"id {kind}, y int, x array<float>",
    )
    table = rows.groupBy("id", "y").agg(F.min("x").alias("x")).toArrow().sort_by("id")
    x = np.array(table["x"].to_pylist(), np.float32).reshape(-1, wordvectors.POOLED)
    y = table["y"].to_numpy().astype(np.float64)
    ids = table["id"].to_pylist()
    aside = np.array([zlib.crc32(f"calibration {i}".encode()) % 5 == 0 for i in ids], bool)
    return QualityModel(vectors, network.fit(x, y, aside))


def score_quality(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    ``score`` is the calibrated probability of label 1 and depends on the text alone; NULL counts
    as empty, and the empty text has a score as well. Repeated rows score alike. Other columns are
    not looked at. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.scores(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(score, pa.float64())],
                ["id", "held_out", "score"],
            )

    given = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        held_out(id_col).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    scored = map_batches(given, run, "id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed(
        "id", id_col
    )


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.scores(batch, text_col)
            yield batch.filter(pa.array(score >= THRESHOLD))

    return map_batches(docs, run, docs.schema)
