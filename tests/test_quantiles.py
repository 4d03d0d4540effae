"""Exact quantiles against numpy."""

import numpy as np
from pyspark.sql import functions as F

from turnwise.operators.explore import describe
from turnwise.operators.quantiles import exact_quantiles, quantiles_outside


def _frame(spark, seed=3, n=20_000):
    rng = np.random.default_rng(seed)
    skewed = np.exp(rng.normal(size=n) * 3)
    signed = rng.normal(size=n) * 1e6
    ties = rng.integers(0, 4, size=n).astype(float)
    holes = [None if i % 5 == 0 else float(x) for i, x in enumerate(skewed)]
    rows = list(zip(skewed.tolist(), signed.tolist(), ties.tolist(), holes, [None] * n))
    return spark.createDataFrame(rows, "skewed double, signed double, ties double, holes double, empty double"), rows


PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_selection_gives_exact_values(spark):
    df, rows = _frame(spark)
    columns = ["skewed", "signed", "ties", "holes", "empty"]
    got = exact_quantiles(df, columns, PROBABILITIES)
    for i, c in enumerate(columns):
        present = [r[i] for r in rows if r[i] is not None]
        want = np.quantile(present, PROBABILITIES).tolist() if present else [None] * len(PROBABILITIES)
        assert got[c] == want or np.allclose(got[c], want, rtol=1e-12)


def test_odd_values(spark):
    """Zeros of both signs, the smallest and largest numbers, one value only, NaN as missing, whole numbers."""
    odd = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0, -1.0, 1e-300, 2.0]
    rows = [(x, 7.5, float("nan") if i % 2 else x, i - 5) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "odd double, same float, holes double, whole int")
    got = exact_quantiles(df, ["odd", "same", "holes", "whole"], PROBABILITIES)
    assert np.allclose(got["odd"], np.quantile(odd, PROBABILITIES), rtol=1e-12)
    assert got["same"] == [7.5] * len(PROBABILITIES)
    assert np.allclose(got["holes"], np.quantile(odd[::2], PROBABILITIES), rtol=1e-12)
    assert np.allclose(got["whole"], np.quantile(range(-5, 6), PROBABILITIES))
    assert exact_quantiles(df.limit(0), ["odd"], [0.5]) == {"odd": [None]} and exact_quantiles(df, [], [0.5]) == {}


def test_one_value_in_a_third_of_all_rows(spark):
    values = [3.0] * 1000 + [3.0 + i / 1e6 for i in range(1000)] + [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert np.allclose(exact_quantiles(df, ["x"], PROBABILITIES)["x"], np.quantile(values, PROBABILITIES), rtol=1e-12)


def test_describe_uses_sample_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double")
    row = describe(df, ["x"]).first()
    assert (row["count"], row["mean"], row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (4, 2.5, 1, 1.75, 2.5, 3.25, 4)
    assert abs(row["std"] - np.std([1, 2, 3, 4], ddof=1)) < 1e-12


def test_quantiles_outside_a_part_are_those_of_the_other_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(None if i % 31 == 0 else i % 4, None if i % 7 == 0 else float(v), float(i % 3)) for i, v in enumerate(rng.normal(size=600) * 50)]
    df = spark.createDataFrame(rows, "part int, v double, w double").withColumn("x", F.when(F.col("part") == 3, F.lit(-5.0)))
    got = quantiles_outside(df, ["v", "w", "x"], [0.1, 0.5], "part", 5)
    assert got == [exact_quantiles(df.filter(F.col("part") != k), ["v", "w", "x"], [0.1, 0.5]) for k in range(5)]
    assert got[3]["x"] == [None, None] and got[0]["x"] == [-5.0, -5.0]
