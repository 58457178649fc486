"""Inputs at the edges: nulls, infinities, empty folds, many weights, several cells on one path."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import ElasticNetPathClassifier, ElasticNetPathRegressor, cross_validate, elastic_net_path, logistic_path
from ridgeline import functions as fn
from ridgeline.operators import screening
from ridgeline.operators.metrics import fold_metrics, regression_metrics
from ridgeline.operators.scoring import linear_score
from ridgeline.session import scratch_path
from ridgeline.sources.text import read_labeled_text


@pytest.mark.parametrize("width", [10, 128, 129, 300])
def test_scores_behave_alike_at_every_width(spark, width):
    weights = np.where(np.arange(width) % 3 == 0, 0.0, 1.0 / (1 + np.arange(width)))
    values = np.sin(np.arange(width)).tolist()
    hidden = list(values)
    hidden[0] = float("nan")  # under a zero weight
    hole = list(values)
    hole[3] = None
    rows = spark.createDataFrame([(0, values), (1, None), (2, hidden), (3, hole)], "k int, x array<double>")
    score = {r["k"]: r["s"] for r in rows.select("k", linear_score(rows, "x", weights, 0.5).alias("s")).collect()}
    assert score[0] == pytest.approx(0.5 + float(np.dot(weights, values)), rel=1e-12)
    assert score[1] is None and math.isnan(score[2]) and score[3] is None
    for wrong in (values[:-1], [*values, 1.0]):
        short = spark.createDataFrame([(wrong,)], "x array<double>")
        with pytest.raises(Exception, match=f"expected {width} features"):
            short.select(linear_score(short, "x", weights, 0.5)).collect()


def test_recode_keeps_null(spark):
    rows = spark.createDataFrame([("F",), ("O",), (None,)], "c string").select(fn.recode("c", "F")).collect()
    assert [r[0] for r in rows] == [1.0, 0.0, None]


def test_min_partitions_is_a_lower_bound(spark):
    path = scratch_path(spark, "text")
    spark.range(80).select(F.concat_ws(",", "id", F.lit("M")).alias("value")).repartition(8).write.text(path)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        assert read_labeled_text(spark, path, convert_label=lambda c: fn.recode(c, "M"), min_partitions=2).rdd.getNumPartitions() >= 8
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_metrics_of_constant_groups(spark):
    rows = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 2.0), (1, 1.0, 0.0), (2, 1.0, 1.5), (2, 3.0, 2.5)], "g int, y double, p double")
    found = {r["g"]: r for r in regression_metrics(rows, "y", "p", "g").collect()}
    assert found[0]["r2"] is None and found[1]["r2"] is None and found[1]["mse"] == 1.0
    assert found[2]["r2"] == pytest.approx(0.75)


def line(spark, n=60):
    return spark.range(n).select(
        "id", (F.col("id") * 1.0).alias("a"), F.sin("id").alias("b"), (F.col("id") * 2 + F.cos("id")).alias("y"), (F.col("id") % 3).cast("int").alias("fold")
    )


def test_folds_without_rows_fail(spark):
    rows = line(spark).withColumn("fold", F.lit(0))
    with pytest.raises(Exception, match="no rows to train on when fold 0"):
        elastic_net_path(rows, "y", ["a", "b"], fold="fold", num_folds=3, num_lambdas=3).collect()
    with pytest.raises(Exception, match="no rows to train on"):
        elastic_net_path(rows.limit(0), "y", ["a", "b"], num_lambdas=3).collect()
    two = line(spark).withColumn("fold", F.col("id").cast("int") % 2)
    with pytest.raises(Exception, match="no held-out rows in fold 2"):
        fold_metrics(elastic_net_path(two, "y", ["a", "b"], fold="fold", num_folds=3, num_lambdas=3)).collect()


def test_constant_held_out_label_has_no_r2(spark):
    rows = line(spark).withColumn("y", F.when(F.col("fold") == 1, 5.0).otherwise(F.col("y")))
    cv = cross_validate(rows, "y", ["a", "b"], [0.5], "fold", 3, metric="rmse", num_lambdas=4)
    assert {r["fold"] for r in cv.metrics.where("r2 is null").collect()} == {1} and cv.best.count() == 1


def test_active_sets_are_kept_apart_by_cell(spark):
    columns = "fold int, cell int, alpha double, lambda_idx int, beta array<double>"
    path = spark.createDataFrame(
        [(0, 0, 0.5, 0, [0.0, 0.0]), (0, 0, 0.5, 2, [0.0, 1.0]), (1, 0, 0.5, 0, [2.0, 1.0]), (1, 0, 0.5, 2, [2.0, 1.0])], columns
    )
    nonzero = screening.nonzero_features(path)
    order = sorted((r["fold"], r["feature"], r["first_idx"], r["position"]) for r in screening.entry_order(nonzero).collect())
    assert order == [(0, 1, 2, 0), (1, 0, 0, 0), (1, 1, 0, 1)]
    fresh = screening.new_features(nonzero.where("lambda_idx = 2"), nonzero.where("lambda_idx = 0"))
    assert [(r["fold"], r["feature"]) for r in fresh.collect()] == [(0, 1)]
    grown = screening.grow_active_set(nonzero.where("lambda_idx = 0"), fresh)
    assert sorted((r["fold"], r["feature"], r["position"]) for r in grown.collect()) == [(0, 1, 0), (1, 0, 0), (1, 1, 1)]
    assert screening.ever_active(nonzero).count() == 3


def test_infinity_is_invalid(spark):
    rows = line(spark).withColumn("y", F.when(F.col("id") == 7, float("inf")).otherwise(F.col("y")))
    with pytest.raises(Exception, match="infinity in label"):
        elastic_net_path(rows, "y", ["a", "b"], num_lambdas=3).collect()
    kept = elastic_net_path(rows, "y", ["a", "b"], num_lambdas=3, handle_invalid="skip").first()
    assert kept["n"] == 59
    arrays = line(spark).withColumn("x", F.when(F.col("id") == 3, F.array(F.lit(float("-inf")), "b")).otherwise(F.array("a", "b")))
    with pytest.raises(Exception, match="infinity in features"):
        elastic_net_path(arrays, "y", "x", num_lambdas=3).collect()
    assert elastic_net_path(arrays, "y", "x", num_lambdas=3, handle_invalid="skip").first()["n"] == 59


def test_logistic_labels_are_zero_or_one(spark):
    rows = line(spark).withColumn("y", F.col("fold") % 2 + 1.0)
    with pytest.raises(Exception, match="must be 0 or 1"):
        logistic_path(rows, "y", ["a", "b"], num_lambdas=2).collect()


def test_estimators_follow_their_own_parameters(spark, monkeypatch):
    from ridgeline.plans import estimators

    used = []
    monkeypatch.setattr(estimators, "lazy_cells", lambda *a, _f=estimators.lazy_cells: used.append("lazy") or _f(*a))
    monkeypatch.setattr(estimators, "moments", lambda *a, _f=estimators.moments: used.append("full") or _f(*a))
    rows = line(spark).select(F.array("a", "b").alias("features"), F.col("y").alias("label"), "id")
    regressor = ElasticNetPathRegressor(numLambdas=5, lambdaIndex=4)
    maps = [{}, {regressor.gramMode: "lazy"}]
    models = dict(regressor.fitMultiple(rows, maps))
    assert sorted(used) == ["full", "lazy"]
    assert np.allclose(models[0].weights.toArray(), models[1].weights.toArray(), atol=1e-3)
    assert models[0].converged is True and models[0].copy().converged is True
    broken = rows.withColumn("label", F.when(F.col("id") == 5, None).otherwise(F.col("label")))
    with pytest.raises(Exception, match="null, NaN or infinity in label"):
        regressor.fit(broken)
    assert regressor.copy({regressor.handleInvalid: "skip"}).fit(broken).weights.size == 2
    classes = rows.withColumn("label", (F.sin(F.col("id") * 7) > 0).cast("double"))
    hasty = ElasticNetPathClassifier(numLambdas=3, lambdaIndex=2, tol=1e-12, maxRounds=1).fit(classes)
    assert hasty.converged is False


def test_fits_leave_nothing_behind(spark):
    import os

    from ridgeline.session import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    rows = line(spark).select(F.array("a", "b").alias("features"), F.col("y").alias("label"))
    before = set(os.listdir(folder))
    ElasticNetPathRegressor(numLambdas=4, lambdaIndex=3, gramMode="lazy").fit(rows)
    ElasticNetPathRegressor(numLambdas=4, lambdaIndex=3).fit(rows)
    assert set(os.listdir(folder)) == before


def test_wide_lazy_folds_equal_full_ones(spark):
    ids = spark.range(150).withColumn("fold", (F.col("id") % 3).cast("int"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda j: F.sin(F.col("id") * (j + 1) * 0.37))
    rows = ids.withColumn("x", wide).withColumn("y", F.get("x", F.lit(3)) * 2 - F.get("x", F.lit(200)) + F.sin("id") / 10)
    options = {"num_lambdas": 6, "lambda_shrink": 0.3, "tol": 1e-12, "max_iter": 3000}
    full = cross_validate(rows, "y", "x", [0.9], "fold", 3, metric="mae", **options)
    lazy = cross_validate(rows, "y", "x", [0.9], "fold", 3, metric="mae", mode="lazy", **options)
    values = lambda cv: [r["mae"] for r in cv.averaged.orderBy("lambda_idx").collect()]
    assert np.allclose(values(full), values(lazy), rtol=1e-7)


def test_partials_are_added_up_in_two_levels(spark):
    from ridgeline.operators.design import design
    from ridgeline.operators.moments import block_moments, merge_salts

    rows = spark.range(0, 1800, numPartitions=600).select(F.sin("id").alias("y"), F.array(F.cos("id"), F.sin(F.col("id") * 2)).alias("x"))
    assert merge_salts(rows) == 24
    plan = block_moments(design(rows, "y", "x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") + plan.count("FlatMapGroupsInPandas") >= 2 or plan.count("Exchange") >= 2
    two = block_moments(design(rows, "y", "x")).first()
    one = block_moments(design(rows.coalesce(4), "y", "x")).first()
    assert two["n"] == one["n"] == 1800 and np.allclose(two["c"], one["c"])
