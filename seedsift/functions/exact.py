"""Sums of doubles that do not depend on the order in which they are added up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_BITS = 44
LIMIT = 2.0**17  # values from here on are added as doubles


def exact_sum(value: str, times: str = "1") -> Column:
    """The sum of ``value * times``, SQL text of a double and a whole number; 0.0 of no values.

    Each value is rounded once to a multiple of 2^-44; these are whole numbers and add up without
    rounding, in partial sums as well, so a shuffle needs one row per task and group. The result is
    exact for these multiples while it is below 512, and the double next to them above. Infinities
    and NaN keep their meaning.
    """
    unit = f"CAST(rint(({value}) * {2.0 ** UNIT_BITS!r}D) AS BIGINT)"
    fits = f"abs({value}) < {LIMIT!r}D"
    parts = [
        f"CASE WHEN {fits} THEN shiftright({unit}, 31) * ({times}) END",
        f"CASE WHEN {fits} THEN ({unit} & 2147483647L) * ({times}) END",
        f"CASE WHEN NOT ({fits}) THEN ({value}) * ({times}) END",
    ]
    high, low, other = (F.sum(F.expr(part)) for part in parts)
    units = F.coalesce(high, F.lit(0)).cast("double") * F.lit(2.0**31) + F.coalesce(
        low, F.lit(0)
    ).cast("double")
    return units * F.lit(2.0**-UNIT_BITS) + F.coalesce(other, F.lit(0.0))
