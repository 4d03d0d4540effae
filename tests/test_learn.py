"""Model fits on a small planted signal."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.learn import certify, models, validate
from turnwise.learn.models import Spec
from turnwise.operators import metrics, quantiles
from turnwise.schemas import BASE_FEATURES

SPEC = Spec("lr", "logistic_regression", ("a", "b"), "y")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 400
    y = rng.integers(0, 2, n)
    a = rng.normal(size=n) + y
    b = rng.normal(size=n) * 5 + 3
    rows = [(f"g{i // 2}", int(y[i]), None if i % 17 == 0 else float(a[i]), float(b[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, y int, a double, b double")
    return validate.with_folds(df, "g", "y")


def _matrix(table):
    rows = table.collect()
    y = np.array([r.y for r in rows], float)
    x = np.array([[np.nan if r.a is None else r.a, r.b] for r in rows])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    return (x - x.mean(0)) / x.std(0), y


def test_logistic_regression_meets_its_optimality_condition(table):
    """Gradient of 0.5*|w|^2 + sum(log loss) vanishes on imputed, standardised rows."""
    model = models.fit(table, SPEC)
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    x, y = _matrix(table)
    residual = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(w + x.T @ residual).max() < 0.05 and abs(residual.sum()) < 0.05


def test_out_of_fold_covers_every_row_once(table):
    out = validate.out_of_fold(table, [SPEC, Spec("rf", "random_forest", ("a", "b"), "y")])
    counts = {r.model: (r.n, r.d) for r in out.groupBy("model").agg(
        F.count("*").alias("n"), F.count_distinct("g", "b").alias("d")).collect()}
    assert counts == {"lr": (400, 400), "rf": (400, 400)}
    pooled, per_fold = validate.evaluate_models(out, "y")
    rows = {r.model: r for r in pooled.collect()}
    assert rows["lr"].roc_auc > 0.65 and rows["rf"].roc_auc > 0.6
    accuracies = [round(r.accuracy, 4) for r in per_fold.collect() if r.model == "lr"]
    assert len(accuracies) == 5 and rows["lr"].fold_acc_std == pytest.approx(np.std(accuracies))


def test_a_fold_is_scored_without_its_rows(table, spark):
    """Scores of a fold do not change when its labels do."""
    flipped = table.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    def fold_zero(df):
        model = models.fit(df.filter("fold <> 0"), SPEC)
        return sorted((r.g, r.b, round(r.p, 9)) for r in models.score(model, df.filter("fold = 0")).collect())
    assert fold_zero(table) == fold_zero(flipped)


def test_save_load_and_weights(table, tmp_path, spark):
    model = models.fit(table, SPEC)
    models.save(model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    a, b = (sorted(tuple(r) for r in models.score(m, table).select("g", "b", "p").collect()) for m in (model, again))
    assert a == b
    weights = [tuple(r) for r in models.importances(model, SPEC.features, spark).collect()]
    assert weights[0][0] == "a" and weights[0][1] > 0.5
    auc = metrics.ranking_metrics(models.score(model, table), "y", "p").first().roc_auc
    assert auc > 0.65


def test_holdout(table):
    row = validate.holdout(table, SPEC).first()
    assert row.model == "lr" and row.tn + row.fp + row.fn + row.tp == table.filter("fold = 0").count()


def test_label_columns_are_refused(table):
    with pytest.raises(ValueError, match="is_cheating_move"):
        models.check_features([*BASE_FEATURES, "is_cheating_move"])
    assert models.usable_features(["a", "player_hint_shown", "b", "assistance_line_rank"]) == ["a", "b"]


def test_medians_interpolate(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None)], "a double, b double")
    assert models.medians(df, ["a", "b"]) == {"a": 2.5, "b": 0.0}


def test_ablation_grid_shapes():
    sizes = {s.name: len(s.features) for s in validate.ablation_specs()}
    assert sizes == {"lr_13": 13, "lr_18": 18, "rf_13": 13, "rf_16": 16, "rf_15": 15, "rf_18": 18}


def test_optimality_holds_for_a_fit_and_fails_for_others(table):
    model = models.fit(table, SPEC)
    rows = certify.optimality(model, table, SPEC).collect()
    assert [r.feature for r in rows] == ["a", "b", certify.INTERCEPT] and all(r.optimal for r in rows)
    x, y = _matrix(table)
    assert [r.observed for r in rows] == pytest.approx([*(x.T @ y), y.sum()])
    held = models.fit(table.filter("fold <> 1"), SPEC)
    assert not all(r.optimal for r in certify.optimality(held, table, SPEC).collect())


def test_a_forest_replays_by_its_node_table(table):
    spec = Spec("rf", "random_forest", ("a", "b"), "y")
    model = models.fit(table, spec)
    want = {(r.g, r.b): r.p for r in models.score(model, table).collect()}
    got = {(r.g, r.b): r.p for r in certify.replay(model, table, spec.features, ["g", "b"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_forests_keep_the_node_of_every_row_and_stay_the_same(table, monkeypatch):
    spec = Spec("rf", "random_forest", ("a", "b"), "y")
    model = models.fit(table, spec).stages[-1]
    assert model.getCacheNodeIds()
    kept, estimator = model.toDebugString, models._estimator
    monkeypatch.setattr(models, "_estimator", lambda *a: estimator(*a).setCacheNodeIds(False))
    walked = models.fit(table, spec).stages[-1].toDebugString
    assert kept.splitlines()[1:] == walked.splitlines()[1:]


def test_kinds_of_fits_do_not_overlap_and_forests_are_few(table, monkeypatch):
    running, seen, lock = [], [], threading.Lock()

    def fit(train, spec, preparation):
        with lock:
            running.append(spec.kind)
            seen.append(tuple(running))
        time.sleep(0.05)
        with lock:
            running.remove(spec.kind)
        return spec.name

    monkeypatch.setattr(validate, "fit", fit)
    specs = [Spec("rf", "random_forest", ("a",), "y"), SPEC, Spec("rf2", "random_forest", ("b",), "y")]
    fitted = validate.fold_models(table, specs)
    assert list(fitted.items()) == [((s.name, k), s.name) for s in specs for k in range(5)]
    assert all(len(set(kinds)) == 1 for kinds in seen)
    assert max(k.count("random_forest") for k in seen) == 3 and max(len(k) for k in seen) <= 5


def test_folds_are_prepared_like_their_training_rows(table, spark):
    """Also for a feature without values outside a fold, and for a fold that holds all rows."""
    odd = table.withColumn("c", F.when(F.col("fold") == 2, F.col("b"))).withColumn("d", F.lit(None).cast("double"))
    features = ["a", "b", "c", "d"]
    for fold, got in enumerate(models.prepare_folds(odd, features, 5)):
        want = models.prepare(odd.filter(F.col("fold") != fold), features)
        assert got.fill == want.fill and got.rows == want.rows
        assert all(got.scale[c] == pytest.approx(want.scale[c], rel=1e-12) for c in features)
    alone = models.prepare_folds(table.filter("fold = 1"), ["a", "b"], 2)[1]
    assert (alone.fill, alone.scale, alone.rows) == ({"a": 0.0, "b": 0.0}, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, 0)


def test_preparing_folds_counts_a_row_once(table, monkeypatch):
    """The passes over the rows give a cell per row and feature, not one per row, feature and fold."""
    cells, counted = [], quantiles._quantiles

    def spy(tally, *rest):
        return counted(lambda column, keys: cells.append(column) or tally(column, keys), *rest)

    monkeypatch.setattr(quantiles, "_quantiles", spy)
    models.prepare_folds(table, ["a", "b"], 5)
    rows = table.count()
    assert len(cells) == 2
    assert table.select(F.sum(F.size(cells[0]))).first()[0] == 2 * rows - table.filter("a is null").count()
