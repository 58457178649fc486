from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ridgeline import ElasticNetPathClassifier, logistic_path

TIGHT = {"num_lambdas": 3, "lambda_shrink": 0.05, "tol": 1e-10, "inner_tol": 1e-12, "max_iter": 2000, "max_rounds": 60}


@pytest.fixture(scope="module")
def binary(sample):
    from pyspark.ml.functions import vector_to_array

    array = vector_to_array("features")
    noisy = (array[3] * 2 + array[5] - array[2] * 0.7 + F.sin(F.col("id") * 12.9898) * 1.5 + 0.8) > 0
    return sample.select("id", "fold", noisy.cast("double").alias("label"), array.alias("features")).cache()


def solve(rows, **options):
    path = logistic_path(rows, "label", "features", **{**TIGHT, **options})
    return path.orderBy("fold", "cell", "lambda_idx").collect()


@pytest.mark.parametrize("alpha", [0.3, 1.0])
def test_points_minimise_the_penalized_likelihood(binary, alpha):
    data = np.array([[r["label"], *r["features"]] for r in binary.collect()])
    y, x = data[:, 0], data[:, 1:]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    for row in solve(binary, alphas=[alpha]):
        beta, lam = np.array(row["beta"]), row["lambda"]
        rest = y - 1 / (1 + np.exp(-(row["beta0"] + z @ beta)))
        slope = z.T @ rest / len(y) - lam * (1 - alpha) * beta
        assert row["converged"]
        assert abs(rest.sum()) < 1e-6
        assert np.all(np.abs(slope) <= lam * alpha + 1e-8)
        active = beta != 0
        assert np.allclose(slope[active], lam * alpha * np.sign(beta[active]), atol=1e-8)
        margin = row["intercept"] + x @ np.array(row["weights"])
        assert np.allclose(margin, row["beta0"] + z @ beta)


def test_folds_equal_filtered_fits(binary):
    together = solve(binary, alphas=[0.5, 1.0], fold="fold", num_folds=3)
    assert len(together) == 4 * 2 * 3
    alone = solve(binary.where("fold <> 1"), alphas=[0.5, 1.0])
    part = [r for r in together if r["fold"] == 1]
    for a, b in zip(part, alone):
        assert np.allclose(a["weights"], b["weights"], atol=1e-7)
        assert a["intercept"] == pytest.approx(b["intercept"], abs=1e-7)


def test_partitioning_does_not_matter(binary):
    results = [
        np.array([r["weights"] for r in solve(binary.repartition(parts), alphas=[0.5])]) for parts in (1, 40)
    ]
    assert np.abs(results[0] - results[1]).max() < 1e-9


def test_merged_bands_and_salts(binary, monkeypatch):
    """Force the two-level merge that wide input and many tasks use."""
    import ridgeline.plans.logistic as module

    base = solve(binary, alphas=[0.5])
    monkeypatch.setattr(module, "BLOCK_CELLS", 0)
    monkeypatch.setattr(module, "SALTS", 0.1)
    merged = module.merge_bands
    used = []
    monkeypatch.setattr(module, "merge_bands", lambda p: used.append(1) or merged(p))
    monkeypatch.setattr(module, "STATE_CELLS", 1)
    forced = solve(binary, alphas=[0.5, 0.5])
    assert used
    for a, b in zip(base, forced):
        assert np.allclose(a["weights"], b["weights"], atol=1e-10)


def test_separable_labels_stay_finite(binary):
    rows = binary.withColumn("label", (F.col("features")[0] > 0).cast("double"))
    path = solve(rows, alphas=[1.0], num_lambdas=6, lambda_shrink=1e-4, tol=1e-3, max_rounds=5)
    assert len(path) == 6
    assert np.isfinite([r["weights"] for r in path]).all()
    assert max(r["rounds"] for r in path) <= 5


def test_one_class(binary):
    path = solve(binary.withColumn("label", F.lit(1.0)), alphas=[1.0])
    assert len(path) == 3
    assert not np.any([r["weights"] for r in path])
    assert path[0]["intercept"] > 10


def test_classifier(binary):
    model = ElasticNetPathClassifier(numLambdas=20, lambdaIndex=19).fit(binary)
    scored = model.transform(binary)
    assert BinaryClassificationEvaluator().evaluate(scored) > 0.8
    row = scored.select("rawPrediction", "probability", "prediction").first()
    assert row["probability"][1] == pytest.approx(1 / (1 + np.exp(-row["rawPrediction"][1])))
    assert row["prediction"] == float(row["probability"][1] > 0.5)
    assert sum(row["probability"]) == pytest.approx(1.0)


def test_carried_steps_reach_the_same_path(binary):
    """Starting the next penalty on the last products saves rounds and changes nothing else."""
    carried, plain = (solve(binary, alphas=[0.6], carry_step=c) for c in (True, False))
    for a, b in zip(carried, plain):
        assert np.allclose(a["weights"], b["weights"], atol=1e-8)
    assert sum(r["rounds"] for r in carried) <= sum(r["rounds"] for r in plain)


def test_classifier_inside_spark_cross_validator(binary):
    from pyspark.ml.tuning import CrossValidator

    from ridgeline.operators.grid import PathParamGridBuilder

    estimator = ElasticNetPathClassifier(numLambdas=3, lambdaShrink=0.05, lambdaIndex=2)
    grid = PathParamGridBuilder().addGrid(estimator.elasticNetParam, [0.5, 1.0]).build_with_index(estimator.lambdaIndex, 3)
    fitted = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(),
        numFolds=3,
        foldCol="fold",
    ).fit(binary)
    assert len(fitted.avgMetrics) == 6 and max(fitted.avgMetrics) > 0.8
    assert fitted.bestModel.numFeatures == 10


def row_by_row(x, y, lambdas, alpha, tol, max_iter=100):
    """Plain loops over penalties, reweighting rounds, passes and features, with a residual for each row."""
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    beta, beta0, points = np.zeros(z.shape[1]), np.log(y.mean() / (1 - y.mean())), []
    beta0 = 0.0  # frozen
    for lam in lambdas:
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.maximum(beta0 + z @ beta, -100)))
            sure = (p < 1e-5) | (1 - p < 1e-5)
            w = np.where(sure, 1e-5, p * (1 - p))
            r = (y - np.where(sure, np.round(p), p)) / w
            new, constant = beta.copy(), 0.0
            for _ in range(max_iter):
                change = 0.0
                for j in range(len(new)):
                    wxr, wxx = (w * z[:, j] * r).mean(), (w * z[:, j] ** 2).mean()
                    move = (w * r).sum() / w.sum()
                    constant += move
                    r = r - move
                    u = wxr + wxx * new[j]
                    value = np.sign(u) * max(abs(u) - lam * alpha, 0) / (wxx + lam * (1 - alpha))
                    r = r - z[:, j] * (value - new[j])
                    change += abs(value - new[j])
                    new[j] = value
                if change <= tol * np.abs(new).sum():
                    break
            distance = np.abs(new - beta).sum() / (np.abs(beta).sum() + 1e-4)
            beta = new
            if distance <= tol:
                break
        points.append(beta.copy())
    return np.array(points)


def test_default_tolerances_follow_plain_loops(binary):
    path = logistic_path(binary, "label", "features", [0.8], num_lambdas=25, freeze_intercept=True, carry_step=False)
    rows = sorted(path.collect(), key=lambda r: r["lambda_idx"])
    lambdas = [r["lambda"] for r in rows]
    assert np.allclose(np.divide(lambdas[1:], lambdas[:-1]), 0.93)
    data = binary.select("features", "label").collect()
    x, y = np.array([r["features"].toArray() if hasattr(r["features"], "toArray") else r["features"] for r in data]), np.array([r["label"] for r in data])
    expected = row_by_row(x, y, lambdas, 0.8, tol=0.01)
    assert np.abs(expected[-1]).max() > 0
    assert np.allclose([r["beta"] for r in rows], expected, atol=1e-8)
