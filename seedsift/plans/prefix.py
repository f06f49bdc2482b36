"""Running totals and ranks over groups that are too large for one task.

A plain window puts each of its groups into a single task. Here the rows are range
partitioned by group and order, each range is summed up on its own, the few range totals are
accumulated, and every range continues from the total before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.plans.bounded import settle


def prefix_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """``df`` plus one column per entry of ``sums``: the total from the start of the group up to
    and including the row. ``order`` must be a total order inside each group; group columns must
    not be NULL."""
    group = list(group)
    values = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    # The range of a row is stored with it, so a recomputed task cannot move it.
    ranged = settle(
        values.repartitionByRange(*[F.col(g) for g in group], *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    per_range = ranged.groupBy("_range", *group).agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    # One row per range and group: as few as there are ranges, plus one per group.
    before = (
        Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_range.select(
        "_range",
        *group,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    inside = (
        Window.partitionBy("_range", *group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = ranged.join(offsets, ["_range", *group])
    return joined.withColumns(
        {name: F.sum(f"_v_{name}").over(inside) + F.col(f"_o_{name}") for name in sums}
    ).select(*df.columns, *sums)


def ranks(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based row numbers per group."""
    return prefix_sums(df, group, order, {name: F.lit(1).cast("bigint")})
