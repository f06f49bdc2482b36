"""Awkward documents: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYLLABLES = "an ber co dé el für ga ñe on qu re st tion un wh".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(
        "".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words)
    )


def rows() -> list[tuple]:
    """(doc_id, text, lang, source)"""
    passage = prose(77, 60)
    found = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n", None, None),
        (4, "word", "en", "b"),
        (5, "word", "en", "b"),
        (5, "word", "en", "b"),
        (None, "word two", None, "a"),
        (None, "word two", None, "a"),
        (6, "w o r d", "en", "c"),
        (7, "x" * 70_000, "en", "a"),
        (8, "x" * 70_000, "en", "a"),
        (9, prose(9, 6000), "de", "a"),
        (10, prose(9, 6000) + " end", "de", "b"),
        (11, "ab " * 400, "de", "b"),
        (12, "AB " * 400, "de", None),
        (13, "<|endoftext|> 日本語 🎉 don't  stop\r\n", "ja", "c"),
    ]
    for i in range(20, 50):
        text = prose(i, 30 + 11 * i)
        if i % 3 == 0:
            text = f"{text}\n{passage} {prose(i + 900, 20)}"
        if i % 10 == 0:
            text += "\nReleased under the MIT License."
        found.append((i, text, "en", "abc"[i % 3] if i % 7 else "a"))
    found += [(100 + i, found[20][1], "en", "a") for i in range(12)]
    found += [(200 + i, f"{found[21][1]} tail{i}", "en", "a") for i in range(8)]
    return found


def documents(spark: SparkSession, some: list[tuple] | None = None) -> DataFrame:
    given = spark.createDataFrame(
        rows() if some is None else some, "doc_id bigint, text string, lang string, source string"
    )
    # Names that the operators use inside.
    for name in ("id", "row", "fp", "n", "key", "size", "kept", "fingerprint", "shard", "_row", "u"):
        given = given.withColumn(name, F.lit("clash"))
    return given.repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, []).limit(0)
