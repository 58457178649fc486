"""Paths of many features: products and gradients of active features only, checked against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import lazy_path, logistic_path, sparse_logistic_path
from ridgeline.plans import lazy
from ridgeline.plans.lazy import ACTIVE_SCHEMA, CHUNK
from ridgeline.sources.synthetic import synthetic_rows

TIGHT = {"num_lambdas": 6, "lambda_shrink": 0.3, "tol": 1e-12, "max_iter": 3000}


def wide_rows(spark, rows: int, width: int):
    made = synthetic_rows(spark.range(rows), "id", width, weights=[1.0, -0.5, 0.25, *[0.0] * (width - 4), 0.7])
    return made.withColumn("fold", F.pmod(F.xxhash64(F.col("features")[0]), F.lit(3)).cast("int")).repartition(5)


def standardized(rows):
    data = [(r.fold, r.label, r.features) for r in rows.collect()]
    return np.array([d[0] for d in data]), np.array([d[1] for d in data]), np.array([d[2] for d in data])


def plain_linear(y, x, alpha, num_lambdas, lambda_shrink, passes=400):
    """Coordinate descent on rows; weights on the scale of the input."""
    n = len(y)
    mean, std = x.mean(0), x.std(0, ddof=1)
    z, t = (x - mean) / std, (y - y.mean()) / y.std(ddof=1)
    xy = z.T @ t / n
    lambdas = np.abs(xy).max() / alpha * lambda_shrink ** (np.arange(1, num_lambdas + 1) / num_lambdas)
    beta, out = np.zeros(x.shape[1]), []
    for lam in lambdas:
        active = np.flatnonzero(beta).tolist()
        while True:
            rest = t - z @ beta
            for _ in range(passes):
                before = beta[active].copy()
                for j in active:
                    old = beta[j]
                    # columns count as of mean square one, as everywhere in this library
                    u = z[:, j] @ rest / n + old
                    beta[j] = np.sign(u) * max(abs(u) - lam * alpha, 0.0) / (1 + lam * (1 - alpha))
                    rest -= z[:, j] * (beta[j] - old)
                if np.abs(beta[active] - before).sum() <= 1e-14:
                    break
            bad = np.flatnonzero((np.abs(z.T @ rest / n) > lam * alpha + 1e-12) & (beta == 0))
            bad = [j for j in bad.tolist() if j not in active]
            if not bad:
                break
            active = sorted({*active, *bad})
        weights = beta * y.std(ddof=1) / std
        out.append(np.append(weights, y.mean() - weights @ mean))
    return np.array(out)


def found(path, held, width):
    rows = sorted((r for r in path if r.fold == held), key=lambda r: r.lambda_idx)
    return np.array([np.append(lazy.spread_out(width, r.indices, r.weights), r.intercept) for r in rows])


def test_ten_thousand_features(spark, tmp_path):
    """No record holds products of the active features with all features, and results are those of plain loops."""
    width = 10_000
    rows = wide_rows(spark, 120, width).cache()
    folder = str(tmp_path / "fit")
    options = TIGHT | {"num_lambdas": 4, "lambda_shrink": 0.45}
    path = lazy_path(rows, "label", "features", [0.9], fold="fold", num_folds=3, journal=folder, **options).collect()
    fold, y, x = standardized(rows)
    for held in (-1, 0, 1, 2):
        own = fold != held
        expected = plain_linear(y[own], x[own], 0.9, options["num_lambdas"], options["lambda_shrink"])
        assert np.abs(found(path, held, width) - expected).max() < 1e-9
    tables = [p.name for p in (tmp_path / "fit").iterdir()]
    active = spark.read.schema(ACTIVE_SCHEMA).parquet(*[f"{folder}/{t}" for t in tables if t.startswith("active-")])
    known = {f for r in active.select("anchors").distinct().collect() for f in r.anchors}
    assert 4 <= len(known) < 600
    # a path's task reads products of active features with active features
    assert active.agg(F.sum(F.size("c")).alias("c")).first().c <= 3 * len(known) ** 2
    for name in tables:
        if name.startswith("products-"):
            products = spark.read.parquet(f"{folder}/{name}")
            assert products.where(F.size("c") > F.size("anchor_mean") * CHUNK).count() == 0
            assert products.select("chunk").distinct().count() == -(-(width + 1) // CHUNK)


def test_checks_hold_points_by_chunk(spark, monkeypatch):
    """What reaches a task of the check is as long as a chunk, whatever the number of features."""
    sizes = []
    real = lazy._fitted_sums

    def spied(*args):
        out = real(*args)
        sizes.append(out.agg(F.max(F.size("fitted")).alias("size")).first()["size"])
        return out

    monkeypatch.setattr(lazy, "_fitted_sums", spied)
    rows = wide_rows(spark, 60, 3000).cache()
    assert len(lazy_path(rows, "label", "features", [0.9], **TIGHT | {"lambda_shrink": 0.5}).collect()) == 6
    assert sizes and max(sizes) <= 6 * CHUNK


def test_a_stopped_fit_goes_on(spark, tmp_path, monkeypatch):
    rows = wide_rows(spark, 80, 700).cache()
    whole = {r.lambda_idx: r for r in lazy_path(rows, "label", "features", [0.8], **TIGHT).collect()}
    folder = str(tmp_path / "fit")
    real, calls = lazy._Fit.one_round, []

    def stopping(self):
        if len(calls) == 3:
            raise KeyboardInterrupt
        calls.append(self.round)
        real(self)

    monkeypatch.setattr(lazy._Fit, "one_round", stopping)
    with pytest.raises(KeyboardInterrupt):
        lazy_path(rows, "label", "features", [0.8], journal=folder, **TIGHT)
    monkeypatch.setattr(lazy._Fit, "one_round", lambda self: calls.append(self.round) or real(self))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "fit").iterdir()}
    path = lazy_path(rows, "label", "features", [0.8], journal=folder, **TIGHT).collect()
    assert calls[3] == 3 and calls == sorted(set(calls))  # no finished round is run again
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "fit").iterdir()}
    assert all(after[name] == stamp for name, stamp in before.items())
    assert len(path) == len(whole)
    for r in path:
        assert r.indices == whole[r.lambda_idx].indices and np.allclose(r.weights, whole[r.lambda_idx].weights, rtol=1e-9)
    # a finished fit reads its points only, and another fit may not use the folder
    rounds = len(calls)
    assert len(lazy_path(rows, "label", "features", [0.8], journal=folder, **TIGHT).collect()) == len(whole)
    assert len(calls) == rounds
    with pytest.raises(ValueError, match="other settings"):
        lazy_path(rows, "label", "features", [0.7], journal=folder, **TIGHT)


def test_shared_penalties(spark):
    rows = wide_rows(spark, 60, 300)
    path = lazy_path(rows, "label", "features", [0.9], fold="fold", num_folds=3, shared_lambdas=True, **TIGHT).collect()
    grids = {}
    for r in path:
        grids.setdefault(r.fold, {})[r.lambda_idx] = r["lambda"]
    assert len(grids) == 4 and all(g == grids[-1] for g in grids.values())


def test_parts_within_the_budget_of_a_task(spark, monkeypatch):
    """Few anchors at a time, so that features of one round lie in several tables."""
    rows = wide_rows(spark, 80, 400).cache()
    whole = lazy_path(rows, "label", "features", [0.5], **TIGHT).orderBy("lambda_idx").collect()
    monkeypatch.setattr(lazy, "FLUSH_BYTES", 16 * 401 * 3)
    parts = lazy_path(rows, "label", "features", [0.5], **TIGHT).orderBy("lambda_idx").collect()
    for a, b in zip(whole, parts):
        assert a.indices == b.indices and np.allclose(a.weights, b.weights, rtol=1e-9)


LOGISTIC = {"num_lambdas": 6, "lambda_shrink": 0.2, "tol": 1e-11, "inner_tol": 1e-13, "max_iter": 4000, "max_rounds": 80}


def logistic_rows(spark, rows, width):
    return wide_rows(spark, rows, width).withColumn("label", (F.col("label") > 0.1).cast("double"))


@pytest.mark.parametrize("options", [{}, {"fit_intercept": False, "num_lambdas": 3}, {"freeze_intercept": True, "num_lambdas": 3}])
def test_active_logistic_equals_full(spark, options):
    rows = logistic_rows(spark, 200, 30).cache()
    both = [
        logistic_path(rows, "label", "features", [0.3, 1.0], fold="fold", num_folds=3, mode=mode, **LOGISTIC | options).orderBy("fold", "cell", "lambda_idx").collect()
        for mode in ("full", "active")
    ]
    assert [len(p) for p in both] == [8 * options.get("num_lambdas", 6)] * 2
    for a, b in zip(*both):
        assert a.asDict().keys() == b.asDict().keys()
        assert (a.fold, a.cell, a.lambda_idx, a.n) == (b.fold, b.cell, b.lambda_idx, b.n) and b.converged
        assert a["lambda"] == pytest.approx(b["lambda"], rel=1e-12)
        assert np.allclose(a.weights, b.weights, atol=1e-7) and a.intercept == pytest.approx(b.intercept, abs=1e-7)


def test_five_thousand_features(spark):
    """Every point meets the optimality conditions; a task holds the active features squared, and one gradient."""
    width = 5000
    rows = logistic_rows(spark, 200, width).cache()
    options = LOGISTIC | {"num_lambdas": 3, "lambda_shrink": 0.4, "tol": 1e-9}
    path = sparse_logistic_path(rows, "label", "features", [0.9], fold="fold", num_folds=3, **options).collect()
    fold, y, x = standardized(rows)
    assert len(path) == 12 and max(len(r.indices) for r in path) > 10
    for r in path:
        own = fold != r.fold
        z = (x[own] - x[own].mean(0)) / x[own].std(0, ddof=1)
        weights = lazy.spread_out(width, r.indices, r.weights)
        p = 1 / (1 + np.exp(-(x[own] @ weights + r.intercept)))
        beta = weights * x[own].std(0, ddof=1)
        slope = z.T @ (y[own] - p) / own.sum() - r["lambda"] * 0.1 * beta
        assert r.n == own.sum() and abs((y[own] - p).mean()) < 1e-7
        assert np.abs(slope).max() <= r["lambda"] * 0.9 + 1e-7
        used = np.array(r.indices, dtype=int)
        assert np.allclose(slope[used], r["lambda"] * 0.9 * np.sign(beta[used]), atol=1e-6)


def test_active_logistic_edge_cases(spark, tmp_path):
    rows = logistic_rows(spark, 50, 6).cache()
    one = rows.withColumn("label", F.lit(1.0))
    constant = [sparse_logistic_path(one, "label", "features", [1.0], **LOGISTIC).collect(), logistic_path(one, "label", "features", [1.0], mode="full", **LOGISTIC).collect()]
    assert [r.lambda_idx for r in sorted(constant[0])] == list(range(6))
    assert {(r.intercept, len(r.indices), r["lambda"]) for r in constant[0]} == {(r.intercept, 0, r["lambda"]) for r in constant[1]}
    with pytest.raises(ValueError, match="no rows"):
        sparse_logistic_path(rows.limit(0), "label", "features", [1.0], **LOGISTIC)
    flat = rows.withColumn("features", F.concat("features", F.array(F.lit(3.0))))
    assert all(6 not in r.indices for r in sparse_logistic_path(flat, "label", "features", [1.0], **LOGISTIC).collect())
    folder = str(tmp_path / "fit")
    first = sparse_logistic_path(rows, "label", "features", [1.0], journal=folder, **LOGISTIC).collect()
    again = sparse_logistic_path(rows, "label", "features", [1.0], journal=folder, **LOGISTIC).collect()
    assert sorted(first) == sorted(again)
