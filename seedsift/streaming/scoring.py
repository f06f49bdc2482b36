"""The token-by-token score applied to a stream of documents.

A document's score depends on nothing but the document and a fixed model, so each micro-batch is
scored by the batch operator and appended. There is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seedsift.functions.ieee import is_member
from seedsift.operators.scoring import class_weights, score_documents


def score_stream(
    documents: DataFrame,
    model: DataFrame,
    klass,
    path: str,
    checkpoint: str,
    n: int = -1,
    text_col: str = "lemmas",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Writes (doc_id, score, is_member, batch) of every arriving document below ``path``.

    A batch that is repeated after a failure replaces its own folder, so no score is written twice.
    """
    weights = class_weights(model, klass, n)  # written out once for all batches

    def score(batch: DataFrame, number: int) -> None:
        scores = score_documents(batch, weights, text_col)
        marked = scores.withColumn("is_member", is_member(scores["score"]))
        marked.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = documents.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
