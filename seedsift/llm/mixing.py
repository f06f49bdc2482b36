"""Sources mixed to target weights, with DataFrame functions only.

Tokens are summed up per source, the targets follow from weights and sizes, and each source gets a
repetition rate: target by size. A document is taken floor(rate) times, and once more if its draw,
a seeded hash, lies below the fraction of the rate. Whatever the number of documents, only the
table of sources is worked on twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import lookup, settle
from seedsift.plans.prefix import ranks

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 29
KEY = ["_none", "_source"]


def word_count(text: str) -> Column:
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def _source_key(source_col: str) -> list[Column]:
    source = F.col(source_col).cast("string")
    return [source.isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source")]


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    """Uniform in [0, 1); NULL ids draw by their text alone."""
    bits = F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col), F.lit(seed))
    return F.shiftrightunsigned(bits, 11).cast("double") * F.lit(2.0**-53)


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """``sizes`` (_none, _source, source_size, n) plus ``target``.

    The weights repeat over the sources in order of code point, NULL last. The targets are in
    proportion to the weights and add up to ``share`` of all sizes, but none exceeds ``cap`` times
    its source's size: the rest is shared out among the others, until none is above.
    """
    placed = settle(
        ranks(sizes, [], [F.col(c) for c in KEY], "_position").withColumn(
            "_weight",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.pmod(F.col("_position") - 1, F.lit(len(weights))) + 1).cast("int"),
            ),
        ),
        "sources",
    )
    limit, weight = F.lit(cap) * F.col("source_size"), F.col("_weight")
    level = 0.0
    while True:
        capped = F.lit(level) * weight > limit
        spent, open_weight, everything = placed.agg(
            F.sum(F.when(capped, limit).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(weight)),
            F.sum("source_size"),
        ).first()
        if not open_weight:
            break
        higher = (share * everything - spent) / open_weight
        if higher <= level:
            break
        level = higher
    return placed.withColumn("target", F.least(F.lit(level) * weight, limit)).drop(
        "_position", "_weight"
    )


def _with_rates(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, options: dict
) -> tuple[DataFrame, DataFrame, int]:
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        word_count(text_col).alias("size"),
        _draw(id_col, text_col, seed).alias("_u"),
        *_source_key(source_col),
    )
    rows = settle(rows, "mix-rows")
    sizes = rows.groupBy(*KEY).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    targets = source_targets(sizes, **options)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    targets = settle(targets.withColumn("_rate", F.coalesce(rate, F.lit(0.0))), "mix-targets")
    return rows, targets, targets.agg(F.sum("n")).first()[0] or 0


def _copies() -> Column:
    whole = F.floor("_rate")
    return (whole + (F.col("_u") < F.col("_rate") - whole).cast("bigint")).cast("bigint")


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    **options,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of ``docs``.

    ``size`` counts words, ``taken`` is ``size`` times ``copies``. NULL and empty texts have size
    0; a source without words has target 0 and takes no copies. A NULL source is a source of its
    own. Rows repeated in full share their draw. Only the three named columns are read; ``options``
    are those of ``source_targets``. An empty table gives an empty result.
    """
    rows, targets, total = _with_rates(docs, id_col, text_col, source_col, seed, options)
    return (
        lookup(rows, targets, KEY, "n", total)
        .withColumn("copies", _copies())
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = SEED,
    **options,
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture takes it."""
    _, targets, total = _with_rates(docs, id_col, text_col, source_col, seed, options)
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        _draw(id_col, text_col, seed).alias("_u"),
        *_source_key(source_col),
    )
    taken = lookup(whole, targets.drop("source_size", "target"), KEY, "n", total)
    return taken.select(
        "_row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int"))).alias("_copy")
    ).select("_row.*")
