"""Stored summaries, matrices in stripes and sparse products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ridgeline import elastic_net_path
from ridgeline.operators import moments as moment_module
from ridgeline.operators.design import design
from ridgeline.operators.gram import cross_products
from ridgeline.operators.moments import gathered, moments, stripes
from ridgeline.operators.profile import column_profile
from ridgeline.operators.scoring import order_of_sparse_weights
from ridgeline.operators.sparse import pair_sums, sparse_gram, sparse_rows, sparse_scales
from ridgeline.operators.stored import StoredMoments, StoredProfile

OPTIONS = {"num_lambdas": 6, "tol": 1e-11, "max_iter": 2000}


def weights(path):
    return np.array([[r.fold, r.lambda_idx, *r.weights, r.intercept] for r in path.orderBy("fold", "cell", "lambda_idx").collect()])


def test_parts_are_added_replaced_and_dropped(spark, sample, tmp_path):
    rows = sample.withColumn("part", F.pmod("id", F.lit(4)))
    stored = StoredMoments(spark, str(tmp_path / "moments"), num_folds=3)
    assert stored.parts() == []
    for part in range(4):
        stored.add(f"p{part}", rows.where(F.col("part") == part), "label", "features", fold="fold")

    def equal(parts, chosen):
        full = elastic_net_path(chosen, "label", "features", [0.4, 1.0], fold="fold", num_folds=3, **OPTIONS)
        assert np.abs(weights(stored.path([0.4, 1.0], parts, **OPTIONS)) - weights(full)).max() < 1e-9

    equal(None, rows)
    equal(["p0", "p2"], rows.where("part in (0, 2)"))
    stored.drop("p1")
    stored.drop("p1")
    equal(None, rows.where("part <> 1"))
    stored.add("p0", rows.where("part = 0 and fold < 3 and label > 0"), "label", "features", fold="fold")
    equal(None, rows.where("part in (2, 3) or (part = 0 and label > 0)"))
    with pytest.raises(ValueError, match="no part"):
        stored.path([1.0], ["p1"])
    with pytest.raises(ValueError, match="no name"):
        stored.add("a/b", rows, "label", "features", fold="fold")
    with pytest.raises(ValueError, match="fold column"):
        stored.add("p9", rows, "label", "features")


def test_merged_profile_far_from_zero(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.sin("id") + 1e8).alias("far"), F.when(F.col("id") % 3 > 0, F.cos("id")).alias("gaps"), F.lit(None).cast("double").alias("none"))
    stored = StoredProfile(spark, str(tmp_path / "profile"))
    for part in range(7):
        stored.add(str(part), rows.where(F.pmod("id", F.lit(7)) == part), ["far", "gaps", "none"])
    merged = {r.feature: r for r in stored.profile().collect()}
    full = {r.feature: r for r in column_profile(rows, ["far", "gaps"]).collect()}
    assert set(merged) == {"far", "gaps"}
    for name, expected in full.items():
        for key, value in expected.asDict().items():
            assert merged[name][key] == (value if isinstance(value, str) else pytest.approx(value, rel=1e-9))
    assert stored.profile([]).count() == 0


def packed(folds, width, rows):
    rng = np.random.default_rng(0)
    for fold in folds:
        block = np.column_stack([np.full(rows, float(fold)), rng.normal(size=(rows, width))])
        yield pa.RecordBatch.from_pydict({"width": pa.array([width + 1], pa.int32()), "packed": pa.array([block.tobytes()], pa.binary())})


def test_a_task_hands_on_partials_within_its_budget():
    """Thirty folds of a matrix each: never more than the budget is held before all is handed on."""
    width, budget = 50, 4 * 8 * 50 * 50
    held, most, total = {}, 0, {}
    for key, part in gathered(packed([f for _ in range(2) for f in range(30)], width, 5), ["width", "packed"], budget=budget):
        held.setdefault(key, 0)
        total[key] = total[key].merge(part) if key in total else part
        most = max(most, part.c.nbytes)
    assert most <= budget / 4 and len(held) == 30
    whole = dict(gathered(packed([f for _ in range(2) for f in range(30)], width, 5), ["width", "packed"]))
    assert all(np.allclose(total[k].c, whole[k].c) and total[k].n == 10 for k in whole)
    stripe = dict(gathered(packed([0], width, 5), ["width", "packed"], 10, 20))[0]
    assert stripe.c.shape == (10, 40)


def test_matrices_in_stripes(spark, monkeypatch):
    rows = spark.range(120).select(
        F.pmod("id", F.lit(3)).cast("int").alias("fold"),
        F.sin(F.col("id") * 1.7).alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(299)), lambda j: F.sin(F.col("id") * (j + 1) * 0.37 + j)).alias("features"),
    ).cache()
    full = cross_products(moments(design(rows, "label", "features", "fold"))).toPandas().set_index(["fold", "i", "j"]).value
    monkeypatch.setattr(moment_module, "WIDTH_LIMIT", 200)
    monkeypatch.setattr(moment_module, "FLUSH_BYTES", 8 * 301 * 109 * 1)
    assert len(stripes(301)) == 3 and stripes(301)[-1][1] == 301
    cut = cross_products(moments(design(rows, "label", "features", "fold"))).toPandas().set_index(["fold", "i", "j"]).value
    assert len(cut) == 3 * 301 * 302 // 2 and (cut - full).abs().max() < 1e-12


def test_wide_input_is_left_to_active_features(spark, monkeypatch):
    rows = spark.range(90).select(
        F.pmod("id", F.lit(3)).cast("int").alias("fold"),
        F.sin(F.col("id") * 1.7).alias("label"),
        F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.sin(F.col("id") * (j + 1) * 0.37 + j)).alias("features"),
    ).cache()
    options = {"num_lambdas": 4, "lambda_shrink": 0.2, "tol": 1e-11, "max_iter": 3000}
    full = elastic_net_path(rows, "label", "features", [0.8], fold="fold", num_folds=3, **options)
    monkeypatch.setattr("ridgeline.plans.linear.WIDTH_LIMIT", 50)
    wide = elastic_net_path(rows, "label", "features", [0.8], fold="fold", num_folds=3, **options)
    assert wide.columns == full.columns and [t for _, t in wide.dtypes] == [t for _, t in full.dtypes]
    assert np.abs(weights(full) - weights(wide)).max() < 1e-8
    errors = [sorted((r.fold, r.lambda_idx, r.test_n, r.test_sse, r.test_sst) for r in p.where("fold >= 0").collect()) for p in (full, wide)]
    assert np.allclose(*errors, rtol=1e-8)


def thin_rows(spark, rows, width, used, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for k in range(rows):
        own = sorted(rng.choice(width, used, replace=False).tolist())
        data.append((k % 2, Vectors.sparse(width, own, rng.normal(size=used).round(3).tolist())))
    return spark.createDataFrame(data, ["fold", "v"])


def test_sparse_products_equal_dense_ones(spark):
    rows = thin_rows(spark, 300, 12, 3).unionByName(spark.createDataFrame([(0, Vectors.dense([0.0, 1.0] * 6)), (1, Vectors.sparse(12, [], []))], ["fold", "v"])).repartition(5)
    data = [(r.fold, r.v.toArray()) for r in rows.collect()]
    got = {(r.fold, r.i, r.j): r.xx for r in sparse_gram(rows, "v", "fold").collect()}
    for fold in (0, 1):
        x = np.array([v for f, v in data if f == fold])
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        xx = z.T @ z / len(x)
        shared = (x != 0).astype(int).T @ (x != 0)
        pairs = {(i, j) for i in range(12) for j in range(i, 12) if shared[i, j]}
        assert {(i, j) for f, i, j in got if f == fold} == pairs
        assert all(got[fold, i, j] == pytest.approx(xx[i, j], abs=1e-10) for i, j in pairs)
        # pairs that share no row follow from the scales
        own = sparse_rows(rows.where(F.col("fold") == fold), "v")
        scales = {r.feature: r for r in sparse_scales(own, pair_sums(own)).collect()}
        for i in range(12):
            for j in range(i, 12):
                if (i, j) not in pairs:
                    a, b = scales[i], scales[j]
                    assert -a.mean * b.mean / (a.std * b.std) == pytest.approx(xx[i, j], abs=1e-10)
    assert sparse_gram(rows.limit(0), "v").count() == 0


def test_sparse_rows_of_a_hundred_thousand_columns(spark):
    """Twenty nonzeros a row make 210 products, whatever the number of columns."""
    rows = thin_rows(spark, 500, 100_000, 20)
    sums = pair_sums(sparse_rows(rows, "v"))
    products = sums.where("i >= 0")
    assert products.count() <= 500 * 210
    assert products.agg(F.sum("s")).first()[0] == pytest.approx(sum((r.v.values.sum() ** 2 + (r.v.values**2).sum()) / 2 for r in rows.collect()))


def test_refused_sparse_rows(spark):
    schema = "v struct<indices: array<int>, values: array<double>>"
    for indices, values in (([1, 1], [1.0, 2.0]), ([1], [float("nan")]), ([1, 2], [1.0]), (None, [1.0])):
        with pytest.raises(Exception, match="null, NaN|differ in length|twice"):
            sparse_gram(spark.createDataFrame([((indices, values),)], schema), "v").collect()
    constant = spark.createDataFrame([(([0, 1], [2.0, float(k)]),) for k in range(1, 4)], schema)
    got = {(r.i, r.j): r.xx for r in sparse_gram(constant, "v").collect()}
    assert got[0, 0] == got[0, 1] == 0.0 and got[1, 1] == pytest.approx(2 / 3)


def test_order_of_sparse_weights(spark):
    points = [(0, 0, 0, [3, 5, 9], [0.5, -2.0, 0.5]), (0, 0, 1, [2, 3], [1.0, 0.0]), (1, 0, 0, [], []), (1, 1, 0, [7], [-1.0])]
    path = spark.createDataFrame(points, "fold int, cell int, lambda_idx int, indices array<int>, weights array<double>")
    got = sorted((r.fold, r.cell, r.lambda_idx, r.feature, r.position) for r in order_of_sparse_weights(path).collect())
    assert got == [(0, 0, 0, 3, 1), (0, 0, 0, 5, 0), (0, 0, 0, 9, 2), (0, 0, 1, 2, 0), (1, 1, 0, 7, 0)]
