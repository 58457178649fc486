from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from ridgeline import ElasticNetPathRegressor, cross_validate
from ridgeline import functions as fn
from ridgeline.operators.compare import assert_close, differences
from ridgeline.operators.grid import PathParamGridBuilder, penalty_grid
from ridgeline.operators.metrics import best_point, regression_metrics
from ridgeline.operators.profile import array_profile, column_profile
from ridgeline.operators.ranking import number_rows
from ridgeline.operators.scoring import linear_score, order_of_weights
from ridgeline.operators.split import hash_fold, random_split
from ridgeline.operators.standardize import column_stats, standardize_columns
from ridgeline.session import scratch_path
from ridgeline.sources.sinks import read_result, write_result
from ridgeline.sources.synthetic import synthetic_linear, synthetic_rows
from ridgeline.sources.text import labeled_rows, read_labeled_text


def test_profile_counts_implicit_zeros(spark):
    vectors = [Vectors.sparse(3, {0: -1.0, 2: 5.0}), Vectors.sparse(3, {0: -2.0, 1: 0.0}), Vectors.dense(-3.0, 0.0, 4.0)]
    rows = array_profile(spark.createDataFrame([(v,) for v in vectors], ["v"]), "v").orderBy("feature").collect()
    dense = np.array([v.toArray() for v in vectors])
    for r, x in zip(rows, dense.T):
        assert (r["n"], r["nnz"], r["min"], r["max"]) == (3, np.count_nonzero(x), x.min(), x.max())
        assert r["mean"] == pytest.approx(x.mean()) and r["variance"] == pytest.approx(x.var(ddof=1))
        assert r["l1"] == pytest.approx(np.abs(x).sum()) and r["l2"] == pytest.approx(np.sqrt((x**2).sum()))


def test_profile_of_one_row(spark):
    row = column_profile(spark.createDataFrame([(2.5,)], ["x"]), ["x"]).first()
    assert (row["n"], row["variance"], row["std"], row["mean"]) == (1, 0.0, 0.0, 2.5)


def test_text_with_label_first_and_odd_delimiter(spark):
    lines = spark.createDataFrame([("1| 2.5 |3",), ("0|4|5.5",), ("",)], ["value"])
    rows = labeled_rows(lines, "|", label_first=True).orderBy("label").collect()
    assert [(r["label"], r["features"]) for r in rows] == [(0.0, [4.0, 5.5]), (1.0, [2.5, 3.0])]


def test_text_file(spark):
    path = scratch_path(spark, "text")
    spark.createDataFrame([("0.5,1,M",), ("0.25,2,R",)], ["value"]).write.text(path)
    rows = read_labeled_text(spark, path, convert_label=lambda c: fn.recode(c, "M"), min_partitions=3)
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r["label"], r["features"][0]) for r in rows.collect()) == [(0.0, 0.25), (1.0, 0.5)]


def test_malformed_text_fails(spark):
    lines = spark.createDataFrame([("1,abc",)], ["value"])
    with pytest.raises(Exception, match="abc"):
        labeled_rows(lines, ",", label_first=True).collect()


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    ids = spark.range(500)
    a, b = (synthetic_rows(ids.repartition(n), "id", 4).orderBy("id").collect() for n in (1, 9))
    assert a == b


def test_synthetic_linear(spark):
    train, test = synthetic_linear(spark, 4000, 5, eps=0.1, intercept=6.2, num_partitions=4)
    assert train.count() + test.count() == 4000
    assert 600 < test.count() < 1000
    stats = array_profile(train, "features").collect()
    assert all(abs(r["variance"] - 1 / 3) < 0.03 and -1 <= r["min"] and r["max"] < 1 for r in stats)
    model = ElasticNetPathRegressor(elasticNetParam=0.2, tol=1e-8).fit(train)
    evaluator = RegressionEvaluator(metricName="rmse")
    assert evaluator.evaluate(model.transform(test)) == pytest.approx(0.1, abs=0.01)
    assert model.intercept == pytest.approx(6.2, abs=0.01)


def test_standardize_constant_column(spark):
    rows = spark.createDataFrame([(1.0, 0.1), (3.0, 0.1), (8.0, 0.1)], ["a", "b"])
    out = standardize_columns(rows, column_stats(rows, ["a", "b"])).toPandas()
    assert out["b"].tolist() == [0.0, 0.0, 0.0]
    assert out["a"].std(ddof=1) == pytest.approx(1.0)


def test_number_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    numbered = number_rows(rows, [F.col("k")], "position").orderBy("k").collect()
    assert [r["position"] for r in numbered] == list(range(1000))


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (5, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 2.5), (3, None), (4, 4.0)], "k int, v double")
    found = {r["k"]: r["problem"] for r in differences(a, b, ["k"], "v", 1e-6).collect()}
    assert found == {2: "differs", 4: "missing", 5: "unexpected"}
    with pytest.raises(AssertionError, match="betas"):
        assert_close(a, b, ["k"], "v", 1e-6, "betas")
    names = spark.createDataFrame([(0, "V1"), (1, "V2")], "k int, v string")
    assert_close(names, names, ["k"], "v", None, "names")


def test_order_of_weights_is_stable(spark):
    row = spark.createDataFrame([([0.0, -3.0, 0.0, 3.0, 1.0],)], "w array<double>").select(order_of_weights("w")).first()
    assert row[0] == [1, 3, 4, 0, 2]


def test_wide_and_narrow_scores_agree(spark, monkeypatch):
    import ridgeline.operators.scoring as scoring

    rows = spark.range(50).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.sin(F.col("id") + j)).alias("x"))
    weights = np.linspace(-1, 1, 10)
    narrow = rows.select(linear_score(rows, "x", weights, 0.5)).collect()
    monkeypatch.setattr(scoring, "EXPRESSION_LIMIT", 2)
    wide = rows.select(linear_score(rows, "x", weights, 0.5)).collect()
    assert np.allclose([r[0] for r in narrow], [r[0] for r in wide])


def test_best_point_breaks_ties_by_grid_order(spark):
    rows = [(1, 0.5, 0, 2.0), (0, 0.2, 3, 2.0), (0, 0.2, 1, 2.0), (0, 0.2, 0, 3.0)]
    best = best_point(spark.createDataFrame(rows, "cell int, alpha double, lambda_idx int, rmse double")).first()
    assert (best["cell"], best["lambda_idx"]) == (0, 1)
    r2 = spark.createDataFrame([(0, 0.2, 0, 0.1), (0, 0.2, 1, 0.9)], "cell int, alpha double, lambda_idx int, r2 double")
    assert best_point(r2, "r2").first()["lambda_idx"] == 1


def test_metrics_match_spark(spark):
    rows = spark.range(100).select(F.sin("id").alias("label"), F.sin(F.col("id") + 0.1).alias("prediction"))
    ours = regression_metrics(rows, "label", "prediction").first()
    for name in ("mse", "rmse", "mae", "r2"):
        assert ours[name] == pytest.approx(RegressionEvaluator(metricName=name).evaluate(rows), rel=1e-12)


def test_grid_is_finite_for_alpha_zero(spark):
    rows = penalty_grid(spark.createDataFrame([(0.5,)], ["top"]), 0.0, 4).collect()
    assert len(rows) == 4 and all(np.isfinite(r["lambda"]) for r in rows)


def test_splits(spark):
    rows = spark.range(1000)
    train, test = random_split(rows, 0.2, 7)
    assert train.count() + test.count() == 1000
    folds = rows.groupBy(hash_fold(["id"], 4).alias("f")).count().collect()
    assert len(folds) == 4 and all(200 < r["count"] < 300 for r in folds)


def test_result_round_trip(spark):
    path = scratch_path(spark, "result")
    rows = spark.createDataFrame([(0, [1.0, 2.0])], "k int, w array<double>")
    write_result(rows, path)
    assert read_result(spark, path).collect() == rows.collect()
    with pytest.raises(Exception, match="exist"):
        write_result(rows, path)


def test_spark_cross_validator_agrees_with_one_pass(sample):
    lr = ElasticNetPathRegressor(numLambdas=6, lambdaIndex=5)
    grid = PathParamGridBuilder().addGrid(lr.elasticNetParam, [0.2, 1.0]).build_with_index(lr.lambdaIndex, 6)
    assert [m[lr.lambdaIndex] for m in grid] == list(range(6)) * 2
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), numFolds=3, foldCol="fold"
    ).fit(sample)
    ours = cross_validate(sample, "label", "features", [0.2, 1.0], "fold", 3, num_lambdas=6)
    averaged = ours.averaged.orderBy("cell", "lambda_idx").collect()
    assert np.allclose([r["rmse"] for r in averaged], cv.avgMetrics, rtol=1e-10)
    assert np.allclose(ours.model.first()["weights"], cv.bestModel.weights.toArray(), atol=1e-12)
    assert "lambdaIndex" in cv.bestModel.explainParams()


def test_fit_many_shares_one_scan_and_honours_overrides(sample, monkeypatch):
    import ridgeline.plans.estimators as module

    scans = []
    plain = module.moments
    monkeypatch.setattr(module, "moments", lambda frame: scans.append(1) or plain(frame))
    lr = ElasticNetPathRegressor(numLambdas=5, lambdaIndex=4)
    maps = [{lr.elasticNetParam: 0.5}, {lr.tol: 1e-9}, {lr.numLambdas: 8, lr.lambdaIndex: 7}, {lr.elasticNetParam: 0.5, lr.lambdaIndex: 0}]
    models = [m for _, m in sorted(lr.fitMultiple(sample, maps), key=lambda p: p[0])]
    assert len(scans) == 1 and len(models) == 4
    assert models[2].getNumLambdas() == 8 and models[0].getElasticNetParam() == 0.5
    alone = lr.copy({lr.elasticNetParam: 0.5}).fit(sample)
    assert np.array_equal(models[0].weights.toArray(), alone.weights.toArray())
    assert models[3].penalty > models[0].penalty


def test_lazy_products_give_the_same_models(sample):
    lr = ElasticNetPathRegressor(elasticNetParam=0.4, numLambdas=8, tol=1e-10, lambdaIndex=7)
    full, lazy = lr.fit(sample), lr.copy({lr.gramMode: "lazy"}).fit(sample)
    assert np.allclose(full.weights.toArray(), lazy.weights.toArray(), atol=1e-7)
    assert full.intercept == pytest.approx(lazy.intercept, abs=1e-7)


def test_index_beyond_the_path_fails_before_any_job(spark):
    lr = ElasticNetPathRegressor(numLambdas=5, lambdaIndex=5)
    with pytest.raises(ValueError, match="lambdaIndex"):
        lr.fit(spark.createDataFrame([], "label double, features array<double>"))


def test_constant_label_gives_one_model_per_map(sample):
    lr = ElasticNetPathRegressor(numLambdas=4, lambdaIndex=3)
    maps = [{lr.lambdaIndex: i} for i in range(4)]
    models = dict(lr.fitMultiple(sample.withColumn("label", F.lit(2.0)), maps))
    assert len(models) == 4
    assert all(m.intercept == 2.0 and not m.weights.toArray().any() for m in models.values())


def test_estimator_saves_and_loads(spark):
    path = scratch_path(spark, "estimator")
    ElasticNetPathRegressor(elasticNetParam=0.3, numLambdas=7).save(path)
    again = ElasticNetPathRegressor.load(path)
    assert again.getElasticNetParam() == 0.3 and again.getNumLambdas() == 7
