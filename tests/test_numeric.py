"""Rounding and casts."""

import random

from pyspark.sql import functions as F

from turnwise.functions.numeric import coerce, rate, round_exact


def test_round_exact_follows_binary_value(values):
    rng = random.Random(5)
    xs = [2.675, 2.665, 0.125, 0.375, 12.125, 1.005, 0.5, 1e-9, 0.0, -0.125, -2.675, 62.45, 2000.0, 1234.565]
    xs += [n / d for n in range(0, 60) for d in (7, 8, 16, 40, 200)]
    xs += [rng.random() * 10 ** rng.randint(-2, 3) for _ in range(500)]
    got = values([(x,) for x in xs], "x double", round_exact("x", 2), round_exact("x", 4))
    assert got == [(round(x, 2), round(x, 4)) for x in xs]


def test_coerce_turns_bad_text_and_nan_into_null(values):
    rows = [("12",), ("1.5",), ("abc",), ("",), ("NaN",), (None,)]
    assert values(rows, "t string", coerce("t")) == [12.0, 1.5, None, None, None, None]


def test_rate_needs_a_positive_denominator(values):
    assert values([(3, 10), (0, 0), (1, -2)], "a int, b int", rate(F.col("a"), F.col("b"))) == [0.3, None, None]
