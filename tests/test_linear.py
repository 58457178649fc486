from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ridgeline import cross_validate, elastic_net_path, lazy_path
from ridgeline.operators.design import design
from ridgeline.operators.gram import cross_products
from ridgeline.operators.metrics import average_metric
from ridgeline.operators.moments import moments
from ridgeline.plans.lazy import densify

TIGHT = {"num_lambdas": 15, "tol": 1e-12, "max_iter": 2000}


@pytest.fixture(scope="module")
def columns(sample):
    from pyspark.ml.functions import vector_to_array

    array = vector_to_array("features")
    return sample.select("id", "fold", "label", *[array[i].alias(f"f{i}") for i in range(6)]).cache()


NAMES = [f"f{i}" for i in range(6)]


def weights(path):
    return np.array([r["weights"] + [r["intercept"]] for r in path.orderBy("fold", "cell", "lambda_idx").collect()])


def matrix(rows, names=NAMES):
    data = rows.select("label", *names).toPandas().to_numpy()
    return data[:, 0], data[:, 1:]


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_every_point_meets_the_optimality_conditions(columns, alpha):
    y, x = matrix(columns)
    n = len(y)
    y = (y - y.mean()) / y.std(ddof=1)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    path = elastic_net_path(columns, "label", NAMES, [alpha], **TIGHT).collect()
    assert len(path) == 15
    for row in path:
        beta, lam = np.array(row["beta"]), row["lambda"]
        assert np.isfinite(lam)
        # the penalized coordinate update takes every column to have mean square 1
        slope = x.T @ y / n - x.T @ (x @ beta) / n - lam * (1 - alpha) * beta
        assert np.all(np.abs(slope) <= lam * alpha + 1e-9)
        active = beta != 0
        assert np.allclose(slope[active], lam * alpha * np.sign(beta[active]), atol=1e-9)


def test_modes_agree(columns):
    base = weights(elastic_net_path(columns, "label", NAMES, [0.4, 1.0], fold="fold", num_folds=3, **TIGHT))
    blocks = weights(
        elastic_net_path(columns, "label", NAMES, [0.4, 1.0], fold="fold", num_folds=3, mode="blocks", **TIGHT)
    )
    assert np.abs(base - blocks).max() < 1e-9
    lazy = weights(densify(lazy_path(columns, "label", NAMES, [0.4, 1.0], **TIGHT)))
    full = weights(elastic_net_path(columns, "label", NAMES, [0.4, 1.0], **TIGHT))
    assert np.abs(lazy - full).max() < 1e-8


def test_wide_moments_in_bands(spark):
    """200 features need several bands, and the training folds are added up band by band."""
    rows = spark.range(300).select(
        F.pmod("id", F.lit(3)).cast("int").alias("fold"),
        (F.sin(F.col("id") * 1.7) * 3).alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(199)), lambda j: F.sin(F.col("id") * (j + 1) * 0.37 + j)).alias("features"),
    )
    table = moments(design(rows, "label", "features", "fold"))
    assert table.where("block > 0").count() > 0
    products = cross_products(table).where("fold = 1").toPandas().pivot(index="i", columns="j", values="value")
    data = np.array([[r["label"], *r["features"]] for r in rows.where("fold = 1").collect()])
    z = (data - data.mean(0)) / data.std(0, ddof=1)
    assert np.nanmax(np.abs(products.to_numpy() - np.triu(z.T @ z / len(z)))[np.triu_indices(201)]) < 1e-12
    path = elastic_net_path(rows, "label", "features", [0.5], fold="fold", num_folds=3, num_lambdas=8, tol=1e-10)
    held = rows.where("fold <> 2")
    alone = elastic_net_path(held, "label", "features", [0.5], num_lambdas=8, tol=1e-10)
    assert np.abs(weights(path.where("fold = 2")) - weights(alone)).max() < 1e-9
    lazy = densify(lazy_path(rows, "label", "features", [0.5], num_lambdas=5, lambda_shrink=0.1, tol=1e-10, max_iter=1000))
    full = elastic_net_path(rows, "label", "features", [0.5], num_lambdas=5, lambda_shrink=0.1, tol=1e-10, max_iter=1000)
    assert np.abs(weights(lazy) - weights(full)).max() < 1e-7


@pytest.mark.parametrize("mode", ["columns", "blocks"])
def test_partitioning_does_not_matter(columns, mode):
    results = []
    for parts in (1, 7, 600):  # 600 leaves empty partitions and single rows
        rows = columns.repartition(parts)
        results.append(weights(elastic_net_path(rows, "label", NAMES, [0.4], mode=mode, **TIGHT)))
    assert np.abs(results[0] - results[1]).max() < 1e-10
    assert np.abs(results[0] - results[2]).max() < 1e-10


def test_far_from_zero_columns_keep_their_digits(columns):
    rows = columns.withColumn("f0", F.col("f0") + 1e7).withColumn("label", F.col("label") - 4e8)
    y, x = matrix(rows)
    z = np.column_stack([y, x])
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    expected = z.T @ z / len(z)
    for mode in ("columns", "blocks"):
        for r in cross_products(moments(design(rows, "label", NAMES), mode)).collect():
            assert r["value"] == pytest.approx(expected[r["i"], r["j"]], abs=1e-7)


def test_constant_label_gives_every_grid_entry(columns):
    path = elastic_net_path(columns.withColumn("label", F.lit(4.5)), "label", NAMES, [0.2, 1.0], num_lambdas=7)
    rows = path.collect()
    assert len(rows) == 14
    assert all(r["intercept"] == 4.5 and not any(r["weights"]) and r["lambda"] is None for r in rows)


def test_one_row(columns):
    rows = elastic_net_path(columns.limit(1), "label", NAMES, [0.2], num_lambdas=3).collect()
    assert len(rows) == 3 and not any(rows[0]["weights"])


def test_constant_and_duplicate_features(columns):
    rows = columns.withColumn("f5", F.lit(0.1)).withColumn("f4", F.col("f3"))
    # equal columns share their weight only slowly when the ridge part is small
    patient = {"num_lambdas": 5, "lambda_shrink": 0.05, "tol": 1e-12, "max_iter": 50000}
    for path in (
        elastic_net_path(rows, "label", NAMES, [0.5], **patient),
        densify(lazy_path(rows, "label", NAMES, [0.5], **patient)),
    ):
        found = weights(path)
        assert np.isfinite(found).all()
        assert not found[:, 5].any()
        assert np.allclose(found[:, 3], found[:, 4], atol=1e-6)


def test_no_intercept(columns):
    y, x = matrix(columns)
    path = elastic_net_path(columns, "label", NAMES, [0.5], fit_intercept=False, **TIGHT).collect()
    last = path[-1]
    sd, sy, n = x.std(0, ddof=1), y.std(ddof=1), len(y)
    beta, lam = np.array(last["beta"]), last["lambda"]
    slope = (x / sd).T @ (y / sy - (x / sd) @ beta) / n - lam * 0.5 * beta
    assert last["intercept"] == 0.0
    active = beta != 0
    assert np.allclose(slope[active], lam * 0.5 * np.sign(beta[active]), atol=1e-8)
    lazy = densify(lazy_path(columns, "label", NAMES, [0.5], fit_intercept=False, **TIGHT))
    assert np.abs(weights(lazy)[-1][:-1] - np.array(last["weights"])).max() < 1e-8


@pytest.mark.parametrize("features", ["columns", "array", "vector"])
def test_null_policy(spark, features):
    rows = [(float(i), float(i % 3), float(i % 5)) for i in range(20)] + [(1.0, None, 2.0), (None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "label double, a double, b double")
    source = ["a", "b"]
    if features != "columns":
        frame = frame.withColumn("features", F.array("a", "b"))
        source = "features"
    if features == "vector":
        from pyspark.ml.functions import array_to_vector

        frame = frame.where("a is not null").withColumn("features", array_to_vector("features"))
    with pytest.raises(Exception, match="null"):
        elastic_net_path(frame, "label", source, [0.5], num_lambdas=3).collect()
    kept = elastic_net_path(frame, "label", source, [0.5], num_lambdas=3, handle_invalid="skip").collect()
    assert kept[0]["n"] == 20


@pytest.mark.parametrize("fold", ["id - 1", "3 + id * 0", "if(id = 7, null, id % 3)"])
@pytest.mark.parametrize("mode", ["columns", "blocks"])
def test_rows_without_a_valid_fold_fail(columns, fold, mode):
    with pytest.raises(Exception, match="fold is null or out of range"):
        elastic_net_path(columns, "label", NAMES, [0.5], fold=F.expr(fold), num_folds=3, mode=mode).collect()


def test_widths_must_agree(spark):
    frame = spark.createDataFrame([(1.0, [1.0, 2.0]), (2.0, [1.0])], "label double, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="widths"):
        elastic_net_path(frame, "label", "features", [0.5], num_lambdas=3).collect()


def test_sparse_vectors_count_missing_entries_as_zero(spark):
    rows = [(float(i), Vectors.sparse(3, {0: float(i + 1), 2: 0.0 if i % 2 else -float(i)})) for i in range(12)]
    sparse = spark.createDataFrame(rows, ["label", "features"])
    dense = spark.createDataFrame([(y, Vectors.dense(v.toArray())) for y, v in rows], ["label", "features"])
    a, b = (weights(elastic_net_path(d, "label", "features", [0.3], num_lambdas=5)) for d in (sparse, dense))
    assert np.array_equal(a, b)


def test_cross_validation_equals_brute_force(columns):
    cv = cross_validate(columns, "label", NAMES, [0.3, 1.0], "fold", 3, **TIGHT)
    found = {(r["alpha"], r["lambda_idx"]): (r["rmse"], r["r2"]) for r in
             average_metric(cv.metrics, "rmse").join(average_metric(cv.metrics, "r2"), ["cell", "alpha", "lambda_idx"]).collect()}
    expected: dict = {}
    for k in range(3):
        path = elastic_net_path(columns.where(f"fold <> {k}"), "label", NAMES, [0.3, 1.0], **TIGHT).collect()
        y, x = matrix(columns.where(f"fold = {k}"))
        for r in path:
            error = y - r["intercept"] - x @ np.array(r["weights"])
            mse = (error**2).mean()
            expected.setdefault((r["alpha"], r["lambda_idx"]), []).append((mse**0.5, 1 - mse / y.var()))
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(np.mean(values, axis=0), rel=1e-9, abs=1e-9)
    best = min(found, key=lambda k: (found[k][0], k))
    row = cv.best.first()
    assert (row["alpha"], row["lambda_idx"]) == best
    assert cv.model.count() == 1 and cv.model.first()["n"] == 501


def test_sparse_and_dense_sweeps_are_the_same(monkeypatch):
    import ridgeline.plans.descent as descent

    draw = np.random.default_rng(5)
    x = draw.normal(size=(80, 120))
    xx, xy = x.T @ x / 80, x.T @ draw.normal(size=80) / 80
    config = descent.PathConfig(alpha=0.8, num_lambdas=10, lambda_shrink=0.1)
    lambdas = descent.lambda_grid(np.abs(xy).max(), config)
    paths = []
    for limit in (0, 10**6):  # always, never jump
        monkeypatch.setattr(descent, "SPARSE_SWEEP", limit)
        paths.append(descent.solve_path(xy, xx, lambdas, config))
    for a, b in zip(*paths):
        assert a.passes == b.passes and np.array_equal(a.beta, b.beta)


def test_shared_lambdas(columns):
    path = elastic_net_path(
        columns, "label", NAMES, [0.3], fold="fold", num_folds=3, shared_lambdas=True, num_lambdas=5
    )
    assert path.select("lambda_idx", F.round("lambda", 12)).distinct().count() == 5


def test_hot_fold_and_missing_fold(columns):
    """Nearly all rows in one fold, and a fold number that no row has."""
    rows = columns.withColumn("fold", F.when(F.col("id") % 50 == 0, 1).otherwise(0))
    path = elastic_net_path(rows, "label", NAMES, [0.5], fold="fold", num_folds=3, num_lambdas=4).collect()
    counts = {r["fold"]: (r["n"], r["test_n"]) for r in path}
    small = columns.where("id % 50 = 0").count()
    assert counts[0] == (small, 501 - small) and counts[1] == (501 - small, small)
    assert counts[2] == (501, None) and counts[-1] == (501, None)


@pytest.mark.parametrize(
    "options", [{"alphas": [1.5]}, {"alphas": [0.5], "num_lambdas": 0}, {"alphas": [0.5], "fold": "fold"}]
)
def test_bad_arguments(columns, options):
    with pytest.raises(ValueError):
        elastic_net_path(columns, "label", NAMES, **options)
