"""Precision, recall and the break-even point of rankings, for many classes at once.

``ranked`` inputs hold retrieved test documents: (klass, id, score, gold). ``sizes`` holds
(klass, n_gold), the number of test documents that belong to the class, for every class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedsift.functions.ieee import ieee_div
from seedsift.plans.bounded import keyed_join, settle
from seedsift.plans.prefix import prefix_sums


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds ``p``, ``r`` and ``f1`` of ``tp`` among ``position`` retrieved and ``n_gold`` wanted."""
    p, r = ieee_div("double(tp)", "double(position)"), ieee_div("double(tp)", "double(n_gold)")
    rates = counts.selectExpr("*", f"{p} AS p", f"{r} AS r")
    # 2 p r / (p + r) in whole numbers; without a true positive it is 0 / 0.
    f1 = "CASE WHEN tp = 0 THEN double('NaN') ELSE double(2 * tp) / (position + n_gold) END"
    return rates.selectExpr("*", f"{f1} AS f1")


def confusion(ranked: DataFrame) -> DataFrame:
    """(klass, tp, fp, retrieved)."""
    return ranked.groupBy("klass").agg(
        F.count_if("gold").alias("tp"),
        F.count_if(~F.col("gold")).alias("fp"),
        F.count(F.lit(1)).alias("retrieved"),
    )


def with_positions(ranked: DataFrame, group=("klass",), order=None) -> DataFrame:
    """Adds ``position`` and ``tp`` along each ranking, without a one-task sort per class."""
    return prefix_sums(
        ranked,
        list(group),
        order or [F.col("score").desc(), F.col("id")],
        {"position": F.lit(1).cast("bigint"), "tp": F.col("gold").cast("bigint")},
    )


def precision_recall_curve(ranked: DataFrame, sizes: DataFrame) -> DataFrame:
    curve = keyed_join(with_positions(ranked), sizes, ["klass"])
    return with_rates(curve)


QUANTILES = 100
ACCURACY = 10_000  # a quantile is off by at most 1 / ACCURACY of a class's rows


def break_even(ranked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(klass, n_gold, position, p, r, f1) where recall first reaches precision.

    With equal true positives, recall reaches precision exactly when the list is as long as the
    class. If the list ends before, its end counts; if nothing is right so far, the first right
    document does; a class with nothing retrieved has no precision (NaN).

    Nothing is ranked but a narrow band of each class: quantiles bracket the score at the wanted
    place, what lies above the bracket is counted, and the few rows inside are put in order.
    """
    ranked = settle(ranked.select("klass", "id", "score", "gold"), "retrieved")
    facts = _brackets(ranked, sizes)
    placed = ranked.join(facts.select("klass", "lo", "hi", "best"), "klass")
    score = F.col("score")
    # NULL stands for an open end; NaN is above all numbers, as in the ranking.
    above = F.coalesce(score > F.col("hi"), F.lit(False))
    inside = ~above & F.coalesce(score >= F.col("lo"), F.lit(True))
    counted = placed.groupBy("klass").agg(
        F.count_if(above).alias("_above"),
        F.count_if(above & F.col("gold")).alias("_tp_above"),
        F.count_if(score > F.col("best")).alias("_better"),
    )
    facts = settle(facts.join(counted, "klass", "left"), "break-even-facts")
    wanted = F.col("n_gold").between(F.lit(1), F.col("retrieved"))
    near = placed.filter(inside).join(facts.filter(wanted).select("klass"), "klass", "left_semi")
    cut = keyed_join(
        with_positions(near.select("klass", "id", "score", "gold")),
        facts.select("klass", "n_gold", "_above", "_tp_above"),
        ["klass"],
    ).filter(F.col("position") + F.col("_above") == F.col("n_gold"))
    cut = cut.select("klass", (F.col("tp") + F.col("_tp_above")).alias("_tp"))
    # The first right document stands after those that score better and the ties before it.
    ties = placed.filter(score == F.col("best")).select("klass", "id", "score", "gold")
    first = with_positions(ties).filter("gold AND tp = 1").select("klass", F.col("position").alias("_tie"))
    found = facts.join(cut, "klass", "left").join(first, "klass", "left")
    right = F.col("_tp") > 0
    some = F.col("found") > 0
    late = some & (F.col("n_gold") <= F.col("retrieved"))
    points = found.select(
        "klass",
        "n_gold",
        F.when(right, F.col("n_gold"))
        .when(late, F.col("_better") + F.col("_tie"))
        .otherwise(F.col("retrieved"))
        .alias("position"),
        F.when(right, F.col("_tp")).when(late, F.lit(1)).otherwise(F.col("found")).alias("tp"),
    )
    return with_rates(points.fillna(0, ["position", "tp"])).select(
        "klass", "n_gold", "position", "p", "r", "f1"
    )


def _brackets(ranked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(klass, n_gold, retrieved, found, best, lo, hi): the number of documents and of right ones,
    the best score of a right one, and scores that enclose that of the ``n_gold``-th document."""
    steps = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    counts = ranked.groupBy("klass").agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.count_if("gold").alias("found"),
        F.max(F.when(F.col("gold"), F.col("score"))).alias("best"),
        F.percentile_approx("score", steps, ACCURACY).alias("_q"),
    )
    known = sizes.select("klass", "n_gold").join(counts, "klass", "left")
    # The wanted place from below; a quantile's own place is known but for `off`.
    rows, off = F.col("retrieved"), F.col("retrieved") / ACCURACY + 2
    place = rows - F.col("n_gold") + 1
    low = F.floor(QUANTILES * (place - off) / rows).cast("int")
    high = F.ceil(QUANTILES * (place + off) / rows).cast("int")
    return settle(
        known.select(
            "klass",
            "n_gold",
            F.coalesce("retrieved", F.lit(0)).alias("retrieved"),
            F.coalesce("found", F.lit(0)).alias("found"),
            "best",
            F.when(low >= 0, F.get("_q", low)).alias("lo"),
            F.when(high <= QUANTILES, F.get("_q", high)).alias("hi"),
        ),
        "brackets",
    )
