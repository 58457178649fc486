"""Paths of sparse rows against those of the same rows made dense."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ridgeline import lazy_path, sparse_path

OPTIONS = {"num_lambdas": 8, "lambda_shrink": 0.004, "tol": 1e-12, "max_iter": 4000}


def thin(spark, rows, width, used, seed=1):
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(rows):
        own = sorted({*rng.choice(width, used, replace=False).tolist(), *(j for j in range(3) if rng.random() < 0.5)})
        values = rng.normal(size=len(own)) + 0.5
        x = dict(zip(own, values))
        data.append((float(2 * x.get(0, 0) - x.get(1, 0) + 0.5 * x.get(2, 0) + 3 + 0.1 * rng.normal()), Vectors.sparse(width, own, values.tolist())))
    return spark.createDataFrame(data, ["label", "v"]).repartition(4).cache()


def same(sparse, dense):
    key = lambda r: (r.cell, r.lambda_idx)
    sparse, dense = sorted(sparse.collect(), key=key), sorted(dense.collect(), key=key)
    assert len(sparse) == len(dense)
    for a, b in zip(sparse, dense):
        assert (a.fold, a.cell, a.lambda_idx, a.width, a.n, a.indices) == (b.fold, b.cell, b.lambda_idx, b.width, b.n, b.indices)
        assert a["lambda"] == pytest.approx(b["lambda"], rel=1e-10)
        assert np.allclose(a.weights, b.weights, atol=1e-8) and a.intercept == pytest.approx(b.intercept, abs=1e-8)
    return sparse


@pytest.mark.parametrize("options", [{}, {"fit_intercept": False}])
def test_equal_to_dense_rows(spark, options):
    rows = thin(spark, 250, 40, 5)
    dense = rows.select("label", vector_to_array("v").alias("x"))
    found = same(sparse_path(rows, "label", "v", [0.3, 1.0], **OPTIONS, **options), lazy_path(dense, "label", "x", [0.3, 1.0], **OPTIONS, **options))
    assert max(len(r.indices) for r in found) >= 8
    pairs = rows.select("label", F.unwrap_udt("v").alias("v")).select("label", F.struct("v.indices", "v.values").alias("v"))
    assert len(same(sparse_path(pairs, "label", "v", [0.3, 1.0], **OPTIONS, **options), lazy_path(dense, "label", "x", [0.3, 1.0], **OPTIONS, **options))) == 16


def test_a_hundred_thousand_features(spark, tmp_path):
    """Every point meets the optimality conditions, and no table holds an array as long as the features."""
    width, folder = 100_000, tmp_path / "fit"
    rows = thin(spark, 400, width, 20)
    options = OPTIONS | {"num_lambdas": 4, "lambda_shrink": 0.05}
    path = sparse_path(rows, "label", "v", [0.9], journal=str(folder), **options).collect()
    data = rows.collect()
    y = np.array([r.label for r in data])
    n, t = len(y), (y - y.mean()) / y.std(ddof=1)
    entries = [(k, j, v) for k, r in enumerate(data) for j, v in zip(r.v.indices.tolist(), r.v.values.tolist())]
    row, column, value = (np.array(c) for c in zip(*entries))
    used, place = np.unique(column, return_inverse=True)
    mean = np.bincount(place, value) / n
    std = np.sqrt((np.bincount(place, value**2) - n * mean**2) / (n - 1))
    assert len(path) == 4 and len(max(path, key=lambda r: r.lambda_idx).indices) >= 2
    for r in path:
        beta = np.zeros(len(used))
        beta[np.searchsorted(used, r.indices)] = r.beta
        fitted = np.bincount(row, value * (beta / std)[place], minlength=n) - (mean / std) @ beta
        rest = t - fitted
        slope = (np.bincount(place, value * rest[row]) - mean * rest.sum()) / std / n - r["lambda"] * 0.1 * beta
        assert np.abs(slope).max() <= r["lambda"] * 0.9 + 1e-9
        assert np.allclose(slope[beta != 0], r["lambda"] * 0.9 * np.sign(beta[beta != 0]), atol=1e-9)
    for table in folder.iterdir():
        if not table.name.startswith("state-"):
            rows = spark.read.parquet(str(table))
            for name, kind in rows.dtypes:
                if kind.startswith("array"):
                    assert rows.agg(F.max(F.size(name))).first()[0] < 5000  # active features at most
    again = sparse_path(thin(spark, 400, width, 20), "label", "v", [0.9], journal=str(folder), **options).collect()
    assert sorted(again) == sorted(path)


def test_edge_cases(spark):
    rows = thin(spark, 30, 6, 2)
    constant = sparse_path(rows.withColumn("label", F.lit(4.0)), "label", "v", [1.0], num_lambdas=3).collect()
    assert [(r.intercept, r.indices, r["lambda"]) for r in constant] == [(4.0, [], None)] * 3
    zero = sparse_path(rows.withColumn("label", F.lit(0.0)), "label", "v", [1.0], num_lambdas=3).collect()
    assert [(r.intercept, r.n) for r in zero] == [(0.0, 30)] * 3
    with pytest.raises(ValueError, match="no rows"):
        sparse_path(rows.limit(0), "label", "v", [1.0])
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="null, NaN or infinity"):
            sparse_path(rows.withColumn("label", bad), "label", "v", [1.0])
