import math

import pytest
from pyspark.sql import functions as F

from seedsift.functions import ieee, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, expected",
    [(1.0, 0.0), (0.0, -math.inf), (-1.0, math.nan), (math.nan, math.nan), (math.inf, math.inf)],
)
def test_ieee_log(spark, value, expected):
    got = one(spark, F.expr(ieee.ieee_log("v")), v=value)
    assert got == pytest.approx(expected, nan_ok=True)


@pytest.mark.parametrize(
    "a, b, expected",
    [
        (1.0, 2.0, 0.5),
        (1.0, 0.0, math.inf),
        (-1.0, 0.0, -math.inf),
        (0.0, 0.0, math.nan),
        (math.nan, 0.0, math.nan),
        (1.0, math.nan, math.nan),
    ],
)
def test_ieee_div(spark, a, b, expected):
    got = one(spark, F.expr(ieee.ieee_div("a", "b")), a=a, b=b)
    assert got == pytest.approx(expected, nan_ok=True)


def test_zero_times_log_zero_by_policy(spark):
    assert math.isnan(one(spark, F.expr(ieee.x_log_x("v")), v=0.0))
    assert one(spark, F.expr(ieee.x_log_x("v", "limit0")), v=0.0) == 0.0


def test_number_states(spark):
    for value, state in ((1.0, "finite"), (math.nan, "nan"), (math.inf, "+inf"), (-math.inf, "-inf")):
        assert one(spark, ieee.number_state("v"), v=value) == state


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("a  b", ["a", "b"]),
        (" a\tb\nc ", ["a", "b", "c"]),
        ("a　b", ["a", "b"]),
        ("a b", ["a b"]),
        ("", []),
        ("x" * 600, ["x" * 600]),
    ],
)
def test_whitespace_tokens(spark, value, tokens):
    assert one(spark, text.whitespace_tokens(F.col("v")), v=value) == tokens


def test_limits_only_where_they_are_asked_for(spark):
    long = " ".join(["same"] * 9_999 + ["last", "beyond"])
    tokens = text.whitespace_tokens(F.col("v"))
    assert one(spark, F.array_distinct(tokens), v=long) == ["same", "last", "beyond"]
    limited = text.whitespace_tokens(F.col("v"), max_tokens=10_000)
    assert one(spark, F.array_distinct(limited), v=long) == ["same", "last"]
    cut = text.whitespace_tokens(F.col("v"), max_word=255)
    assert one(spark, cut, v="x" * 600) == ["x" * 255, "x" * 255, "x" * 90]


def test_space_tokens_keep_other_whitespace(spark):
    assert one(spark, text.space_tokens(F.col("v")), v="a  b\nc") == ["a", "", "b\nc"]


@pytest.mark.parametrize(
    "term, kept",
    [("ab", False), ("abc", True), ("äöü", True), ("\U0001f600", False), ("\U0001f600a", True), ("€€", False)],
)
def test_minimum_length_in_utf16_units(spark, term, kept):
    assert one(spark, text.long_enough(F.col("v")), v=term) is kept


@pytest.mark.parametrize("length", [75, 76, 77])
def test_snippet(spark, length):
    got = one(spark, text.snippet(F.col("v")), v="x" * length)
    assert got == ("x" * 75 + "..." if length == 77 else "x" * length)

