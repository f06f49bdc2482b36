"""Logarithm and division with IEEE-754 results, as SQL expressions.

Spark gives NULL for ``ln(0)`` and raises on division by zero under ANSI mode. The
feature scores need -Inf, +Inf and NaN instead, because a NaN score has a place in the
ranking (it sorts first).

The functions take and return SQL text over DOUBLE columns, so that a long formula reaches
Spark as one expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = "double('NaN')"
INF = "double('Infinity')"


def ieee_log(x: str) -> str:
    """Natural log: ln(0) = -Inf, ln(negative) = NaN, NULL stays NULL."""
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) WHEN ({x}) = 0 THEN -{INF} WHEN ({x}) < 0 THEN {NAN} END)"


def ieee_div(a: str, b: str) -> str:
    """a / b: x/0 = +-Inf by the sign of x, 0/0 = NaN, NULL stays NULL."""
    return (
        f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) IS NULL THEN NULL"
        f" WHEN isnan({a}) OR ({a}) = 0 THEN {NAN} WHEN ({a}) > 0 THEN {INF} WHEN ({a}) < 0 THEN -{INF} END)"
    )


def x_log_x(x: str, nan_policy: str = "ieee") -> str:
    """x ln x. At x = 0 this is NaN under ``ieee`` and the limit 0 under ``limit0``."""
    if nan_policy == "limit0":
        return f"(CASE WHEN ({x}) = 0 THEN 0D ELSE ({x}) * {ieee_log(x)} END)"
    return f"(({x}) * {ieee_log(x)})"


def x_log_x_over(x: str, total: str) -> str:
    """x ln x / total, the entropy term of the count based mutual information."""
    return ieee_div(x_log_x(x), total)


def binomial_log_likelihood(n: str, size: str, pc: str, pj: str) -> str:
    """n (ln pc - ln pj) + (size - n) ln(1 - pc/pj), the building block of the likelihood ratio."""
    miss = ieee_log(f"1D - {ieee_div(pc, pj)}")
    return f"(({n}) * ({ieee_log(pc)} - {ieee_log(pj)}) + (({size}) - ({n})) * {miss})"


def number_state(x: str) -> Column:
    """'finite', 'nan', '+inf' or '-inf'."""
    return F.expr(
        f"CASE WHEN isnan({x}) THEN 'nan' WHEN {x} = {INF} THEN '+inf'"
        f" WHEN {x} = -{INF} THEN '-inf' WHEN {x} IS NOT NULL THEN 'finite' END"
    )


def finite_or_null(x: str) -> Column:
    return F.when(number_state(x) == "finite", F.col(x))


def odds(log_score: Column) -> Column:
    """A log score as plain odds."""
    return F.exp(log_score)


def is_member(score: Column) -> Column:
    """Decision rule: strictly above zero."""
    return score > 0
