"""Scoring of all points on held-out rows, and cross-validation of logistic paths."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import cross_validate, cross_validate_logistic
from ridgeline.operators import held_out
from ridgeline.sources.synthetic import synthetic_rows

OPTIONS = {"num_lambdas": 5, "lambda_shrink": 0.1}
TIGHT = {"num_lambdas": 4, "lambda_shrink": 0.1, "tol": 1e-10, "inner_tol": 1e-12, "max_iter": 3000, "max_rounds": 60}


def rows_of(spark, rows=400, width=8):
    made = synthetic_rows(spark.range(rows), "id", width, weights=[1.0, -0.5, 0.25, *[0.0] * (width - 3)])
    # two thirds of all rows are in one fold
    fold = F.when(F.pmod(F.xxhash64(F.col("features")[0]), F.lit(6)) < 4, 0).otherwise(F.pmod(F.xxhash64(F.col("features")[1]), F.lit(2)).cast("int") + 1)
    return made.withColumn("fold", fold).repartition(6).cache()


def metrics(cv, *names):
    return sorted(tuple(r) for r in cv.metrics.select("fold", "cell", "lambda_idx", *names).collect())


@pytest.mark.parametrize("mode", ["auto", "lazy"])
def test_points_in_blocks_give_the_same_errors(spark, monkeypatch, mode):
    rows = rows_of(spark)
    sent = cross_validate(rows, "label", "features", [0.5, 1.0], "fold", 3, metric="mae", mode=mode, **OPTIONS)
    whole = metrics(sent, "mse", "mae")
    monkeypatch.setattr(held_out, "POINT_CELLS", 20)  # a few points meet a few rows in each task
    monkeypatch.setattr(held_out, "ROW_BLOCKS", 1)
    monkeypatch.setattr(held_out, "PACKED_CELLS", 300)
    met = metrics(cross_validate(rows, "label", "features", [0.5, 1.0], "fold", 3, metric="mae", mode=mode, **OPTIONS), "mse", "mae")
    assert len(whole) == 30 and np.allclose(whole, met, rtol=1e-9)


def test_blocks_are_bounded(spark, monkeypatch):
    """Beyond the limit no process gets all points, and a fold of many rows is dealt to several tasks."""
    monkeypatch.setattr(held_out, "POINT_CELLS", 30)
    monkeypatch.setattr(held_out, "ROW_BLOCKS", 2)
    monkeypatch.setattr(held_out, "PACKED_CELLS", 200)
    monkeypatch.setattr(held_out, "_sent_to_rows", None)
    seen = []
    real = held_out.Points.of.__func__
    monkeypatch.setattr(held_out.Points, "of", classmethod(lambda cls, rows: seen.append(len(rows)) or real(cls, rows)))
    rows = rows_of(spark)
    cv = cross_validate(rows, "label", "features", [0.5], "fold", 3, metric="mae", **OPTIONS)
    assert cv.metrics.count() == 15 and not seen  # points are put together in tasks only


def exact_area(label, score):
    order = score[label == 1][:, None] - score[label == 0]
    return ((order > 0) + 0.5 * (order == 0)).mean()


@pytest.mark.parametrize("mode", ["full", "active"])
def test_logistic_metrics(spark, monkeypatch, mode):
    rows = rows_of(spark).withColumn("label", (F.col("label") > 0.1).cast("double"))
    cv = cross_validate_logistic(rows, "label", "features", [0.5, 1.0], "fold", 3, bins=256, mode=mode, **TIGHT)
    data = [(r.fold, r.label, r.features) for r in rows.collect()]
    fold, y, x = (np.array([d[i] for d in data]) for i in range(3))
    points = {(r.fold, r.cell, r.lambda_idx): r for r in cv.path.collect()}
    found = cv.metrics.collect()
    assert len(points) == 32 and len(found) == 24
    averages = {}
    for r in found:
        point = points[r.fold, r.cell, r.lambda_idx]
        weights = np.zeros(8)
        weights[list(point.indices) if mode == "active" else slice(None)] = point.weights
        own = fold == r.fold
        margin = x[own] @ weights + point.intercept
        p = 1 / (1 + np.exp(-margin))
        assert r.n == own.sum()
        assert r.log_loss == pytest.approx(-(y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p)).mean(), abs=1e-10)
        assert r.accuracy == pytest.approx(((p > 0.5) == (y[own] == 1)).mean())
        assert abs(r.auc - exact_area(y[own], margin)) <= r.auc_bound + 1e-12 and r.auc_bound < 0.1
        averages.setdefault((r.cell, r.lambda_idx), []).append(r.log_loss)
    best = cv.best.first()
    assert best.log_loss == pytest.approx(min(map(np.mean, averages.values())))
    assert cv.model.first().lambda_idx == best.lambda_idx and cv.model.first().fold == -1
    largest = cross_validate_logistic(rows, "label", "features", [0.5, 1.0], "fold", 3, metric="auc", mode=mode, **TIGHT)
    assert largest.best.first().auc == pytest.approx(max(r.auc for r in largest.averaged.collect()))
    monkeypatch.setattr(held_out, "POINT_CELLS", 64)
    again = cross_validate_logistic(rows, "label", "features", [0.5, 1.0], "fold", 3, bins=256, mode=mode, **TIGHT)
    assert np.allclose(metrics(cv, "log_loss", "accuracy", "auc"), metrics(again, "log_loss", "accuracy", "auc"))


def test_folds_of_one_class_and_without_rows(spark):
    rows = rows_of(spark).withColumn("label", (F.col("label") > 0.1).cast("double"))
    one = rows.where("fold <> 2 or label = 1")
    found = cross_validate_logistic(one, "label", "features", [1.0], "fold", 3, **TIGHT).metrics.collect()
    assert all((r.auc is None) == (r.fold == 2) and r.log_loss > 0 for r in found)
    with pytest.raises(Exception, match="no held-out rows in fold 2"):
        cross_validate_logistic(rows.where("fold <> 2"), "label", "features", [1.0], "fold", 3, **TIGHT).metrics.collect()
    with pytest.raises(ValueError, match="metric"):
        cross_validate_logistic(rows, "label", "features", [1.0], "fold", 3, metric="rmse")
