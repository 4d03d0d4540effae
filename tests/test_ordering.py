"""Split numbering and running totals against brute force, with hot keys."""

import random

from pyspark.sql import functions as F

from turnwise.operators.ordering import number_rows, running_totals
from turnwise.sources import adapters


def _rows(seed=1, n=3000):
    """Key 0 holds a third of all rows."""
    rng = random.Random(seed)
    return [(0 if i % 3 == 0 else rng.randint(1, 40), rng.randint(0, 30), i) for i in range(n)]


def test_hot_keys_number_like_a_plain_window(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, day int, id int")
    for hot_rows in (10, 500, 10**6):
        out = number_rows(df, ["k"], ["day", "id"], "n", spread="day", hot_rows=hot_rows)
        got = {r.id: r.n for r in out.collect()}
        seen, want = {}, {}
        for k, day, i in sorted(rows):
            seen[k] = seen.get(k, 0) + 1
            want[i] = seen[k]
        assert got == want


def test_hot_key_is_cut_into_bounded_pieces(spark):
    """No window partition of the split key holds more than one day of it."""
    df = spark.createDataFrame(_rows(), "k int, day int, id int")
    plan = number_rows(df, ["k"], ["day", "id"], "n", spread="day", hot_rows=10)._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(k" in plan and "__bucket" in plan


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 3), x, rng.randint(1, 5)) for x in rng.sample(range(10000), 800)]
    df = spark.createDataFrame(rows, "k int, x int, v int")
    for bucket in (F.floor(F.col("x") / 100), F.lit(0), F.col("x")):
        out = running_totals(df, ["k"], ["x"], bucket, {"upto": "v"}).collect()
        total, want = {}, {}
        for k, x, v in sorted(rows):
            total[k] = total.get(k, 0) + v
            want[k, x] = total[k]
        assert {(r.k, r.x): r.upto for r in out} == want


def test_adapter_is_the_same_with_split_parts(spark):
    folder = "/root/testdata/sf0.001"
    plain = adapters.plies(spark, folder)
    split = adapters.plies(spark, folder, hot_rows=20)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_one_key_with_all_rows_on_one_day(spark):
    df = spark.range(2000).selectExpr("cast(null as int) as k", "1 as day", "id")
    out = number_rows(df, ["k"], ["day", "id"], "n", spread=F.struct("day", F.shiftright("id", 6)), hot_rows=10)
    assert {r.id: r.n for r in out.collect()} == {i: i + 1 for i in range(2000)}


def test_null_keys_and_buckets_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, None, 1), (2, 1, 7)], "k int, x int, v int")
    out = running_totals(df, ["k"], ["x"], F.col("x"), {"upto": "v"}).collect()
    assert sorted((r.k is None, r.upto) for r in out) == [(False, 7), (True, 1), (True, 6)]
