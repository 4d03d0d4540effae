"""Folds and metrics against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import folds, metrics


def _auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def _ap(rows):
    total, out, before = sum(y for y, _ in rows), 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        picked = [y for y, s in rows if s >= t]
        recall = sum(picked) / total
        out += (recall - before) * sum(picked) / len(picked)
        before = recall
    return out


@pytest.mark.parametrize("spread", ["ties", "smooth", "crowded"])
def test_metrics_match_brute_force(spark, spread):
    rng = random.Random(7)
    def score(y):
        if spread == "ties":
            return rng.randint(0, 10) / 10
        if spread == "smooth":
            return min(max(rng.gauss(0.45 + 0.1 * y, 0.2), 0.0), 1.0)
        return rng.random() * 1e-6 * (1 + y)
    rows = [(i % 3, y, score(y)) for i, y in enumerate(rng.randint(0, 1) for _ in range(400))]
    df = spark.createDataFrame(rows, "k int, y int, s double")
    for r in metrics.evaluate(df, "y", "s", by=["k"]).collect():
        mine = [(y, s) for k, y, s in rows if k == r.k]
        assert abs(r.roc_auc - _auc(mine)) < 1e-12 and abs(r.pr_auc - _ap(mine)) < 1e-12
        tp, fp = sum(y for y, s in mine if s >= 0.5), sum(1 - y for y, s in mine if s >= 0.5)
        assert (r.tp, r.fp) == (tp, fp) and r.tp + r.fn == sum(y for y, _ in mine)
        assert abs(r.accuracy - sum((s >= 0.5) == bool(y) for y, s in mine) / len(mine)) < 1e-12
        assert r.precision == (tp / (tp + fp) if tp + fp else 0.0)
    whole = metrics.evaluate(df, "y", "s").first()
    assert abs(whole.roc_auc - _auc([r[1:] for r in rows])) < 1e-12


def test_bucket_never_decreases(spark):
    rng = random.Random(1)
    xs = sorted([0.0, 1.0, 1e-300, 1 - 1e-16, 0.5] + [rng.random() for _ in range(500)] + [rng.random() * 1e-9 for _ in range(99)])
    out = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select(
        "i", metrics.score_bucket(F.col("x")).alias("b")
    ).orderBy("i").collect()
    buckets = [r.b for r in out]
    assert buckets == sorted(buckets)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    row = metrics.evaluate(df, "y", "s").first()
    assert row.roc_auc is None and row.pr_auc == 1.0


def test_folds_keep_groups_and_spread_strata(spark):
    rows = [(f"m{i}", int(j == 0 and i % 3 == 0)) for i in range(300) for j in range(2)]
    df = spark.createDataFrame(rows, "g string, y int")
    out = folds.assign_folds(df, "g", "y")
    assert out.count() == 300 and out.select("g").distinct().count() == 300
    per_fold = {r.fold: (r.n, r.p) for r in out.groupBy("fold").agg(F.count("*").alias("n"), F.sum("positives").alias("p")).collect()}
    assert sorted(per_fold) == list(range(5))
    assert all(n == 60 and p == 20 for n, p in per_fold.values())
    other = folds.assign_folds(df, "g", "y", seed=7)
    assert out.select("g", "fold").exceptAll(other.select("g", "fold")).count() > 0
    summary = folds.fold_summary(out, "g").collect()
    assert all(r.overlap_groups == 0 and r.train_rows == 480 and r.train_groups == 240 for r in summary)


def _unevenness(sizes, fold_of):
    """Sum over both labels of the squared shares of the folds; 2 / folds at best."""
    load = [[0, 0] for _ in range(5)]
    for g, (rows, pos) in sizes.items():
        load[fold_of[g]][0] += pos
        load[fold_of[g]][1] += rows - pos
    return sum((x / max(sum(column), 1)) ** 2 for column in zip(*load) for x in column)


@pytest.mark.parametrize("case", ["few large", "one huge", "no positives", "many sizes"])
def test_balanced_folds_are_as_even_as_greedy_ones_by_hand(spark, case):
    rng = random.Random(3)
    sizes = {
        "few large": {f"g{i}": (40 + i, 10 * (i % 3)) for i in range(7)} | {f"s{i}": (1, i % 2) for i in range(60)},
        "one huge": {"g": (500, 200)} | {f"s{i}": (2, i % 3) for i in range(600)},
        "no positives": {f"s{i}": (1 + i % 4, 0) for i in range(50)},
        "many sizes": {f"s{i}": (r := rng.randint(1, 60), rng.randint(0, r)) for i in range(200)},
    }[case]
    df = spark.createDataFrame([(g, int(k < p)) for g, (r, p) in sizes.items() for k in range(r)], "g string, y int")
    out = folds.balanced_folds(df, "g", "y").collect()
    assert {r.g: (r.rows, r.positives) for r in out} == sizes
    got = _unevenness(sizes, {r.g: r.fold for r in out})
    plain = _unevenness(sizes, {r.g: r.fold for r in folds.assign_folds(df, "g", "y").collect()})
    assert got <= plain + 1e-9
    totals = sum(p for _, p in sizes.values()), sum(r - p for r, p in sizes.values())
    load, want = [[0, 0] for _ in range(5)], {}
    share = lambda p, q: ((p * totals[1]) ** 2 + (q * totals[0]) ** 2, p + q, p)
    for g, (r, p) in sorted(sizes.items(), key=lambda s: share(s[1][1], s[1][0] - s[1][1]), reverse=True):
        f = min(range(5), key=lambda f: (load[f][0] * p * totals[1] ** 2 + load[f][1] * (r - p) * totals[0] ** 2, sum(load[f]), f))
        load[f][0] += p
        load[f][1] += r - p
        want[g] = f
    assert got == pytest.approx(_unevenness(sizes, want))


def test_dealing_in_lots_stays_even_and_whole():
    shares = folds.deal([(2, 1, 1_000_003), (900_000, 100_000, 1)], 5)
    assert sum(shares[2, 1]) == 1_000_003 and sum(shares[900_000, 100_000]) == 1
    huge = shares[900_000, 100_000].index(1)
    rows = [2 * n + 900_000 * (k == huge) for k, n in enumerate(shares[2, 1])]
    assert max(rows) - min(rows) < 800_000 and shares[2, 1][huge] == min(shares[2, 1])
    assert folds.deal([], 5) == {}


def test_balanced_folds_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), (None, 0), (None, None)], "g string, y int")
    assert sorted((r.g or "", r.rows, r.positives) for r in folds.balanced_folds(df, "g", "y").collect()) == [
        ("", 2, 0), ("a", 1, 0), ("b", 1, 1)]
    assert folds.balanced_folds(df.limit(0), "g", "y").count() == 0


def test_leak_is_found(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 2)], "g string, fold int")
    got = {r.fold: (r.val_groups, r.overlap_groups) for r in folds.leakage(df, "g").collect()}
    assert got == {0: (2, 1), 1: (1, 1), 2: (1, 0)}
    with pytest.raises(RuntimeError):
        folds.require_no_leak(df, "g")
    groups = df.withColumns({"rows": F.lit(1), "positives": F.lit(0)})
    assert sum(r.overlap_groups for r in folds.fold_summary(groups, "g").collect()) == 2
    folds.require_no_leak(df.filter("g <> 'a'"), "g")


def test_metric_deltas(spark):
    df = spark.createDataFrame([("a", 0.70994, 0.5), ("b", 0.71391, 0.25)], "v string, accuracy double, recall double")
    got = {r.metric: (r.baseline, r.other, r.delta) for r in metrics.metric_deltas(df, "v", "a", "b", metrics=["accuracy", "recall"]).collect()}
    assert got == {"accuracy": (0.7099, 0.7139, 0.004), "recall": (0.5, 0.25, -0.25)}


def test_rows_without_a_score_or_label_count_nowhere(spark):
    rows = [(1, 0.9), (0, 0.2), (1, None), (0, float("nan")), (None, 0.7)]
    df = spark.createDataFrame(rows, "y int, p double")
    row = metrics.evaluate(df, "y", "p").first()
    assert (row.tn, row.fp, row.fn, row.tp, row.roc_auc, row.pr_auc) == (1, 0, 0, 1, 1.0, 1.0)
    cells = metrics.threshold_metrics(df, "y", "p").first()
    assert cells.tn + cells.fp + cells.fn + cells.tp == 2


def test_groups_without_labels_or_id_get_a_fold(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), (None, 0), (None, None)], "g string, y int")
    assert sorted((r.g or "", r.rows, r.positives) for r in folds.assign_folds(df, "g", "y").collect()) == [
        ("", 2, 0), ("a", 1, 0), ("b", 1, 1)]
