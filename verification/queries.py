"""One query per operator. Every query reads whole tables; folds and splits use keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ridgeline import functions as fn
from ridgeline import (
    ElasticNetPathRegressor,
    cross_validate,
    cross_validate_logistic,
    elastic_net_path,
    lazy_path,
    logistic_path,
    ship_package,
)
from ridgeline.operators import profile, screening
from ridgeline.operators.compare import differences
from ridgeline.operators.design import design
from ridgeline.operators.gram import cross_products, direct_label_products, feature_products, largest_product
from ridgeline.operators.grid import PathParamGridBuilder, grid_points, logistic_grid, penalty_grid
from ridgeline.operators.metrics import average_metric, best_point, fold_metrics, regression_metrics
from ridgeline.operators.moments import moments
from ridgeline.operators.scoring import order_of_sparse_weights, order_of_weights, pick_point, predict, residuals, weights_to_input_scale
from ridgeline.operators.sparse import sparse_gram
from ridgeline.operators.split import key_fold, key_split
from ridgeline.operators.standardize import column_stats, standardize_columns
from ridgeline.operators.stored import StoredMoments, StoredProfile
from ridgeline.operators.weighted import start_sums, weighted_products
from ridgeline.plans.lazy import densify
from ridgeline.session import materialize, scratch_path
from ridgeline.sources.sinks import read_result, write_result
from ridgeline.sources.synthetic import synthetic_rows
from ridgeline.sources.text import read_labeled_text

Query = Callable[[SparkSession, str], DataFrame]

FEATURES = ["l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_linenumber"]
TIGHT = {"num_lambdas": 20, "tol": 1e-13, "max_iter": 1000}  # both engines stop at the fixed point
FIXED_WEIGHTS = [0.95, -51000.5, 48000.25, 0.0, 1.5]
FIXED_INTERCEPT = 120.5
LOGISTIC_TIGHT = {
    "num_lambdas": 5,
    "lambda_shrink": 0.05,
    "tol": 1e-12,
    "inner_tol": 1e-13,
    "max_iter": 2000,
    "max_rounds": 60,
}

LOGISTIC_BINS = 64  # of the area under the curve

_REGISTRY: dict[str, Query] = {}


def register(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    _REGISTRY[query.__name__] = run
    return query


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column, digits: int):
    """Round for comparison; adding 0.0 removes a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def charge():
    """The regression label: what a line item costs after discount and tax."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))


def lineitem(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("charge", charge())


def line_path(spark, sf_dir, alphas=(0.5,), **options) -> DataFrame:
    return elastic_net_path(lineitem(spark, sf_dir), "charge", FEATURES, alphas, **{**TIGHT, **options})


def line_products(spark, sf_dir, **options) -> DataFrame:
    frame = design(lineitem(spark, sf_dir), "charge", FEATURES, **options)
    return cross_products(moments(frame))


def line_label_products(spark, sf_dir, **options) -> DataFrame:
    return direct_label_products(design(lineitem(spark, sf_dir), "charge", FEATURES, **options))


def tidy_path(path: DataFrame) -> DataFrame:
    """One row per path point and feature."""
    zipped = F.arrays_zip("weights", "beta")
    long = path.select("fold", "alpha", "lambda_idx", "lambda", "intercept", F.posexplode(zipped).alias("feature", "v"))
    return long.select(
        "fold",
        "alpha",
        "lambda_idx",
        "feature",
        rounded("lambda", 8).alias("lambda"),
        rounded("intercept", 2).alias("intercept"),
        rounded("v.weights", 3).alias("weight"),
        rounded("v.beta", 7).alias("beta"),
    )


def error_events(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("is_error", fn.recode("event_type", "error")).withColumn(
        "margin", (F.col("value") - 50.0) / 4.0
    )


def labelled_documents(spark, sf_dir) -> DataFrame:
    """Quality labels with the log length and the share of blanks of each document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.length("text")
    blanks = size - F.length(F.replace("text", F.lit(" ")))
    features = documents.select(
        "doc_id", F.log(size.cast("double")).alias("log_size"), (blanks / size).alias("blank_share")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return labels.join(features, "doc_id")


# sources and sinks


def order_lines(spark, sf_dir) -> str:
    """Orders written as delimited text with the status as label at the end."""
    path = scratch_path(spark, "order-lines")
    orders = table(spark, sf_dir, "orders")
    orders.select(F.concat_ws(",", "o_orderkey", "o_totalprice", "o_orderstatus")).write.text(path)
    return path


@register
def s1_labeled_text(spark, sf_dir):
    rows = read_labeled_text(spark, order_lines(spark, sf_dir), convert_label=lambda c: fn.recode(c, "F"))
    return rows.select(
        F.element_at("features", 1).cast("bigint").alias("o_orderkey"),
        "label",
        F.element_at("features", 2).alias("total"),
    )


@register
def s2_text_min_partitions(spark, sf_dir):
    rows = read_labeled_text(
        spark, order_lines(spark, sf_dir), convert_label=lambda c: fn.recode(c, "F"), min_partitions=4
    )
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")
    )
    return parts.agg(
        F.sum("n").alias("n"),
        F.sum("positives").alias("positives"),
        (F.count(F.lit(1)) >= 4).alias("at_least_four"),
    )


@register
def s4_synthetic_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select("o_orderkey")
    weights = [0.5, -0.25, 0.125]
    rows = synthetic_rows(ids, "o_orderkey", 3, eps=0.1, intercept=6.2, weights=weights)
    noise = F.col("label") - fn.dot("features", weights, 6.2)
    outside = F.exists("features", lambda v: (v < -1.0) | (v >= 1.0))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(outside.cast("long")).alias("outside"),
        F.sum((F.abs(noise) > 0.1 * 9).cast("long")).alias("far"),
        (F.abs(F.var_samp(F.element_at("features", 1)) * 3 - 1) < 0.1).alias("variance_is_third"),
        (F.abs(F.stddev_samp(noise) - 0.1) < 0.01).alias("noise_is_eps"),
    )


@register
def s5_result_sink(spark, sf_dir):
    path = scratch_path(spark, "path")
    write_result(line_path(spark, sf_dir), path)
    return tidy_path(read_result(spark, path))


# projections and predicates


@register
def p1_select(spark, sf_dir):
    return design(lineitem(spark, sf_dir), "charge", FEATURES).rows.select(
        rounded("label", 7).alias("label"), F.col("x0").alias("price"), F.col("x4").alias("linenumber")
    )


@register
def p2_flat_row(spark, sf_dir):
    flat = design(lineitem(spark, sf_dir), "charge", FEATURES).flat()
    return flat.select(
        F.size("row").alias("slots"),
        rounded(F.element_at("row", 1), 7).alias("label"),
        F.element_at("row", 2).alias("price"),
        F.element_at("row", -1).alias("linenumber"),
    )


@register
def p3_recode_label(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", fn.recode("o_orderstatus", "F").alias("label"))


@register
def p4_standardize_all(spark, sf_dir):
    columns = ["charge", *FEATURES]
    rows = lineitem(spark, sf_dir).select("l_orderkey", *columns)
    scaled = standardize_columns(rows, column_stats(rows, columns))
    return scaled.select("l_orderkey", *[rounded(c, 6).alias(c) for c in columns])


@register
def p5_standardize_features(spark, sf_dir):
    rows = error_events(spark, sf_dir).select("event_id", "is_error", "value", "user_id")
    scaled = standardize_columns(rows, column_stats(rows, ["value", "user_id"]))
    return scaled.select(
        "event_id", "is_error", rounded("value", 6).alias("value"), rounded("user_id", 6).alias("user_id")
    )


@register
def p6_slice_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("picked", fn.slice_array("embedding", [5, 0, 63]))
    return rows.select(
        "vec_id", *[F.element_at("picked", i + 1).cast("double").alias(f"value{i}") for i in range(3)]
    )


@register
def p7_start_set(spark, sf_dir):
    xy = line_label_products(spark, sf_dir)
    grid = penalty_grid(largest_product(xy), 0.5, 20).where("lambda_idx = 0").select("fold", "lambda")
    chosen = screening.start_set(xy.join(F.broadcast(grid), "fold"), "lambda", 0.5)  # one row per fold
    return chosen.select("feature", rounded("xy", 7).alias("xy"))


@register
def p8_new_features(spark, sf_dir):
    nonzero = screening.nonzero_features(line_path(spark, sf_dir))
    active = nonzero.where("lambda_idx = 0").select("feature")
    later = nonzero.where("lambda_idx = 19")
    return screening.new_features(later, active).select("feature", rounded("coefficient", 7).alias("beta"))


@register
def p9_residual(spark, sf_dir):
    scored = predict(lineitem(spark, sf_dir), FEATURES, FIXED_WEIGHTS, FIXED_INTERCEPT)
    return residuals(scored, "charge").select("l_orderkey", rounded("residual", 6).alias("residual"))


@register
def p10_dot_product(spark, sf_dir):
    weights = [((i * 7) % 11 - 5) / 4 for i in range(64)]
    rows = table(spark, sf_dir, "embeddings")
    score = fn.dot(F.col("embedding").cast("array<double>"), weights, 0.25)
    return rows.select("vec_id", rounded(score, 7).alias("score"))


@register
def p11_soft_threshold(spark, sf_dir):
    centred = F.col("value") - 50.0
    return table(spark, sf_dir, "events").select(
        "event_id", rounded(fn.soft_threshold(centred, 10.0), 6).alias("shrunk")
    )


@register
def p12_logistic_probability(spark, sf_dir):
    rows = error_events(spark, sf_dir).select("event_id", (F.col("margin") * 12).alias("margin"))
    return rows.select("event_id", rounded(fn.logistic_probability("margin"), 9).alias("probability"))


@register
def p13_irls_weight(spark, sf_dir):
    rows = error_events(spark, sf_dir).withColumn("p", fn.logistic_probability("margin"))
    return rows.select(
        "event_id",
        rounded(fn.clamped_probability("p"), 9).alias("p"),
        rounded(fn.working_weight("p"), 9).alias("w"),
    )


@register
def p14_working_response(spark, sf_dir):
    rows = error_events(spark, sf_dir).withColumn("margin", F.col("margin") / 8)
    rows = rows.withColumn("p", fn.logistic_probability("margin"))
    z = fn.working_response("is_error", "p", "margin")
    new_margin = F.col("margin") * 0.75 + 0.1
    return rows.select("event_id", rounded(z, 6).alias("z"), rounded(z - new_margin, 6).alias("r"))


# active sets


@register
def u1_grow_active_set(spark, sf_dir):
    nonzero = screening.nonzero_features(line_path(spark, sf_dir))
    active = nonzero.where("lambda_idx = 2").select("feature")
    fresh = screening.new_features(nonzero.where("lambda_idx = 12"), active)
    return screening.grow_active_set(active, fresh).select("feature", "position")


@register
def u2_ever_active(spark, sf_dir):
    return screening.ever_active(screening.nonzero_features(line_path(spark, sf_dir))).select("feature")


def discount_alphas(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") + 0.1).alias("alpha")).distinct()


@register
def u3_grid_points(spark, sf_dir):
    points = grid_points(discount_alphas(spark, sf_dir), 20)
    return points.select(rounded("alpha", 6).alias("alpha"), "lambda_idx")


# column statistics


def statistic(df: DataFrame, columns: list[str], aggregate, digits: int | None) -> DataFrame:
    entries = []
    for i, name in enumerate(columns):
        value = aggregate(F.col(name).cast("double"))
        value = value if digits is None else rounded(value, digits)
        entries.append(F.struct(F.lit(name).alias("feature"), value.alias("value")).alias(f"s{i}"))
    return df.agg(*entries).select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


@register
def a1_mean(spark, sf_dir):
    return statistic(table(spark, sf_dir, "lineitem"), FEATURES, profile.mean, 6)


@register
def a2_variance(spark, sf_dir):
    return statistic(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], profile.variance, 5)


@register
def a3_count(spark, sf_dir):
    return statistic(table(spark, sf_dir, "events"), ["value", "user_id"], F.count, None)


@register
def a4_num_nonzeros(spark, sf_dir):
    return statistic(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], profile.num_nonzeros, None)


@register
def a5_max(spark, sf_dir):
    return statistic(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], F.max, None)


@register
def a6_min(spark, sf_dir):
    return statistic(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], F.min, None)


@register
def a7_norm_l2(spark, sf_dir):
    return statistic(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"], profile.norm_l2, 4)


@register
def a8_norm_l1(spark, sf_dir):
    return statistic(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], profile.norm_l1, 1)


def compact_profile(rows: DataFrame, digits: int) -> DataFrame:
    values = [rounded(c, digits).alias(c) for c in ("mean", "variance", "std", "max", "min", "l2", "l1")]
    return rows.select("feature", "n", "nnz", *values)


@register
def a9_column_profile(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    return compact_profile(profile.column_profile(table(spark, sf_dir, "lineitem"), columns), 5)


@register
def a9_array_profile(spark, sf_dir):
    return compact_profile(profile.array_profile(table(spark, sf_dir, "embeddings"), "embedding"), 7)


@register
def a9_merged_profile(spark, sf_dir):
    """Parts of the lines, stored one by one; one of them is stored twice, and one is taken out and put back."""
    rows = table(spark, sf_dir, "lineitem")
    stored = StoredProfile(spark, scratch_path(spark, "profile"))
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    for part in (0, 1, 2, 1):
        stored.add(f"part{part}", rows.where(key_fold("l_orderkey", 4) == part), columns)
    stored.drop("part0")
    for part in (3, 0):
        stored.add(f"part{part}", rows.where(key_fold("l_orderkey", 4) == part), columns)
    return compact_profile(stored.profile(), 5)


@register
def a10_label_stats(spark, sf_dir):
    stats = profile.label_profile(lineitem(spark, sf_dir), "charge")
    return stats.select("n", rounded("mean", 5).alias("mean"), rounded("std", 5).alias("std"))


@register
def a11_row_count(spark, sf_dir):
    return profile.row_count(lineitem(spark, sf_dir))


@register
def a12_entry_order(spark, sf_dir):
    order = screening.entry_order(screening.nonzero_features(line_path(spark, sf_dir)))
    return order.select("feature", "first_idx", "position")


def fold_paths(spark, sf_dir) -> DataFrame:
    """Nonzero features of the paths of three folds and of all rows, for two alphas."""
    path = line_path(spark, sf_dir, alphas=(0.5, 1.0), fold=key_fold("l_orderkey", 3), num_folds=3)
    return screening.nonzero_features(path)


@register
def a12_entry_order_cells(spark, sf_dir):
    return screening.entry_order(fold_paths(spark, sf_dir)).select("fold", "alpha", "feature", "first_idx", "position")


@register
def p8_new_features_cells(spark, sf_dir):
    nonzero = materialize(fold_paths(spark, sf_dir), "nonzero")
    fresh = screening.new_features(nonzero.where("lambda_idx = 19"), nonzero.where("lambda_idx = 4"))
    return fresh.select("fold", "alpha", "feature", rounded("coefficient", 7).alias("beta"))


@register
def u1_grow_active_set_cells(spark, sf_dir):
    nonzero = materialize(fold_paths(spark, sf_dir), "nonzero")
    active = nonzero.where("lambda_idx = 2")
    fresh = screening.new_features(nonzero.where("lambda_idx = 12"), active)
    return screening.grow_active_set(active, fresh).select("fold", "alpha", "feature", "position")


@register
def u2_ever_active_cells(spark, sf_dir):
    return screening.ever_active(fold_paths(spark, sf_dir)).select("fold", "alpha", "feature")


@register
def a13_label_products(spark, sf_dir):
    fold = key_fold("l_orderkey", 3)
    return line_label_products(spark, sf_dir, fold=fold).select("fold", "feature", rounded("xy", 9).alias("xy"))


@register
def a14_gram_columns(spark, sf_dir):
    fold = key_fold("l_orderkey", 3)
    products = feature_products(line_products(spark, sf_dir, fold=fold))
    return products.select("fold", "i", "j", rounded("xx", 9).alias("xx"))


@register
def a14_gram_blocks(spark, sf_dir):
    frame = design(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return feature_products(cross_products(moments(frame, "blocks"))).select("i", "j", rounded("xx", 9).alias("xx"))


def thinned(spark, sf_dir) -> DataFrame:
    """The large components of each vector, as indices and values."""
    large = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.abs(F.get("embedding", i)) > 0.15)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", large.alias("indices"))
    values = F.transform("indices", lambda i: F.get("embedding", i).cast("double"))
    return rows.select("vec_id", F.struct("indices", values.alias("values")).alias("thin"))


@register
def a14_gram_sparse(spark, sf_dir):
    products = sparse_gram(thinned(spark, sf_dir), "thin", key_fold("vec_id", 2))
    return products.select("fold", "i", "j", rounded("xx", 9).alias("xx"))


@register
def a15_largest_product(spark, sf_dir):
    fold = key_fold("l_orderkey", 3)
    top = largest_product(line_label_products(spark, sf_dir, fold=fold))
    return top.select("fold", rounded("top", 9).alias("top"))


@register
def a16_logistic_start_sums(spark, sf_dir):
    events = error_events(spark, sf_dir)
    stats = column_stats(events, ["value", "user_id", "is_error"])
    label_mean, _ = stats.pop("is_error")
    sums = start_sums(events, "is_error", stats, label_mean)
    return sums.select("feature", *[rounded(c, 5).alias(c) for c in ("wxr", "wxx", "wr", "w")])


@register
def a17_weighted_products(spark, sf_dir):
    events = error_events(spark, sf_dir)
    features = [F.col("value") / 100.0, F.col("user_id") / 1000.0]
    products = weighted_products(events, "is_error", features, -0.75, [0.5, -0.25])
    return products.select("i", "j", rounded("value", 5).alias("value"))


# order, picking


@register
def o1_order_of_weights(spark, sf_dir):
    path = line_path(spark, sf_dir)
    return path.select("lambda_idx", F.posexplode(order_of_weights("weights")).alias("position", "feature"))


@register
def o1_order_wide(spark, sf_dir):
    """The order of the nonzero weights of every point of paths of 64 features."""
    path = lazy_path(embedded(spark, sf_dir), "y", "embedding", [0.5], fold=key_fold("vec_id", 3), num_folds=3, **EMBEDDED)
    return order_of_sparse_weights(path).select("fold", "lambda_idx", "feature", "position")


@register
def o2_pick_point(spark, sf_dir):
    return tidy_path(pick_point(line_path(spark, sf_dir), 7))


@register
def o3_best_point(spark, sf_dir):
    best = line_cv(spark, sf_dir).best
    return best.select("alpha", "lambda_idx", rounded("rmse", 4).alias("rmse"))


# grids, paths and models


@register
def m1_linear_grid(spark, sf_dir):
    top = largest_product(line_label_products(spark, sf_dir, fold=key_fold("l_orderkey", 3)))
    return penalty_grid(top, 0.2, 100).select("fold", "lambda_idx", rounded("lambda", 8).alias("lambda"))


@register
def m2_logistic_grid(spark, sf_dir):
    events = error_events(spark, sf_dir)
    stats = column_stats(events, ["value", "user_id", "is_error"])
    label_mean, _ = stats.pop("is_error")
    sums = start_sums(events, "is_error", stats, label_mean)
    rows = F.col("w") / F.lit(label_mean * (1.0 - label_mean))  # every row has the same weight
    top = sums.agg(F.max(F.abs("wxr") / rows).alias("top"))
    return logistic_grid(top, 0.8, 30).select("lambda_idx", rounded("lambda", 10).alias("lambda"))


@register
def m5_path(spark, sf_dir):
    return tidy_path(line_path(spark, sf_dir))


@register
def m5_path_folds(spark, sf_dir):
    return tidy_path(line_path(spark, sf_dir, (0.5, 1.0), fold=key_fold("l_orderkey", 3), num_folds=3))


@register
def m5_path_incremental(spark, sf_dir):
    """Moments of three parts of the lines are stored; then a fourth is added, and all folds are fitted anew."""
    rows = lineitem(spark, sf_dir)
    stored = StoredMoments(spark, scratch_path(spark, "stored-moments"), num_folds=3)
    for part in range(4):
        own = rows.where(key_fold("l_suppkey", 4) == part)
        stored.add(f"part{part}", own, "charge", FEATURES, fold=key_fold("l_orderkey", 3))
    return tidy_path(stored.path([0.5], **TIGHT))


@register
def m5_path_blocks(spark, sf_dir):
    return tidy_path(
        line_path(spark, sf_dir, (0.2,), fold=key_fold("l_orderkey", 3), num_folds=3, mode="blocks")
    )


@register
def m5_path_lazy(spark, sf_dir):
    path = lazy_path(lineitem(spark, sf_dir), "charge", FEATURES, [0.5], **TIGHT)
    return tidy_path(densify(path))


def regressor(**params) -> ElasticNetPathRegressor:
    return ElasticNetPathRegressor(
        labelCol="charge", numLambdas=20, tol=1e-13, maxIter=1000, lambdaIndex=7, **params
    )


def assembled(spark, sf_dir) -> DataFrame:
    return lineitem(spark, sf_dir).withColumn("features", F.array(*[F.col(c).cast("double") for c in FEATURES]))


def model_rows(spark, models) -> DataFrame:
    rows = [
        (number, feature, float(weight), model.intercept)
        for number, model in models
        for feature, weight in enumerate(model.weights.toArray())
    ]
    frame = spark.createDataFrame(rows, "model int, feature int, weight double, intercept double")
    return frame.select(
        "model", "feature", rounded("weight", 3).alias("weight"), rounded("intercept", 2).alias("intercept")
    )


@register
def m6_fit_one(spark, sf_dir):
    model = regressor(elasticNetParam=0.5).fit(assembled(spark, sf_dir))
    return model_rows(spark, [(0, model)])


@register
def m7_fit_many(spark, sf_dir):
    estimator = regressor()
    grid = PathParamGridBuilder().addGrid(estimator.elasticNetParam, [0.5, 1.0]).build_with_index(
        estimator.lambdaIndex, 20
    )
    models = estimator.fitMultiple(assembled(spark, sf_dir), grid)
    return model_rows(spark, sorted(models, key=lambda m: m[0]))


@register
def m8_input_scale(spark, sf_dir):
    table_ = moments(design(lineitem(spark, sf_dir), "charge", FEATURES))
    deviations = F.transform(
        F.sequence(F.lit(0), F.size("mean") - 1),
        lambda i: F.sqrt(F.get("c", i * F.size("mean") + i) / (F.col("n") - 1)),
    )
    stats = table_.select(F.lit(-1).alias("fold"), "mean", deviations.alias("std"))
    return tidy_path(weights_to_input_scale(line_path(spark, sf_dir), stats))


@register
def m9_constant_label(spark, sf_dir):
    constant = F.when(F.col("l_quantity") >= 0, F.lit(7.25)).otherwise(F.lit(7.25))
    rows = lineitem(spark, sf_dir).withColumn("label", constant)
    path = elastic_net_path(rows, "label", FEATURES, [0.5], num_lambdas=20)
    return path.select(
        "lambda_idx",
        "intercept",
        F.aggregate("weights", F.lit(0.0), lambda total, w: total + F.abs(w)).alias("weight_sum"),
        "n",
    )


@register
def m10_transform(spark, sf_dir):
    rows = assembled(spark, sf_dir)
    model = regressor(elasticNetParam=0.5).fit(rows)
    return model.transform(rows).select("l_orderkey", "l_linenumber", rounded("prediction", 3).alias("prediction"))


WIDE_WEIGHTS = [((i * 7) % 11 - 5) / 8 for i in range(192)]  # some are zero


@register
def m10_transform_wide(spark, sf_dir):
    """A model of 192 features, more than generated code takes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat("embedding", F.reverse("embedding"), "embedding").alias("features"))
    scored = predict(rows, "features", WIDE_WEIGHTS, 0.25)
    return scored.select("vec_id", rounded("prediction", 6).alias("prediction"))


def document_path(spark, sf_dir) -> DataFrame:
    rows = labelled_documents(spark, sf_dir)
    return logistic_path(rows, "quality", ["log_size", "blank_share"], [0.9], **LOGISTIC_TIGHT)


@register
def m11_logistic_path(spark, sf_dir):
    long = document_path(spark, sf_dir).select("lambda_idx", "lambda", "beta0", F.posexplode("beta").alias("feature", "b"))
    return long.select(
        "lambda_idx",
        "feature",
        rounded("lambda", 8).alias("lambda"),
        rounded("beta0", 5).alias("beta0"),
        rounded("b", 5).alias("beta"),
    )


@register
def m13_logistic_model(spark, sf_dir):
    model = pick_point(document_path(spark, sf_dir), 4)
    long = model.select("intercept", F.posexplode("weights").alias("feature", "w"))
    return long.select("feature", rounded("intercept", 4).alias("intercept"), rounded("w", 4).alias("weight"))


@register
def m15_key_split(spark, sf_dir):
    train, test = key_split(lineitem(spark, sf_dir), "l_orderkey", 5, 0)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_orderkey").alias("first_key"),
        rounded(F.avg("charge"), 5).alias("mean_charge"),
    )


def line_cv(spark, sf_dir):
    return cross_validate(
        lineitem(spark, sf_dir), "charge", FEATURES, [0.5, 1.0], key_fold("l_orderkey", 3), 3, **TIGHT
    )


@register
def m16_cross_validation(spark, sf_dir):
    cv = line_cv(spark, sf_dir)
    averaged = average_metric(cv.metrics, "rmse").join(average_metric(cv.metrics, "r2"), ["cell", "alpha", "lambda_idx"])
    return averaged.select("alpha", "lambda_idx", rounded("rmse", 4).alias("rmse"), rounded("r2", 8).alias("r2"))


@register
def m16_cross_validation_mae(spark, sf_dir):
    cv = cross_validate(
        lineitem(spark, sf_dir), "charge", FEATURES, [0.5, 1.0], key_fold("l_orderkey", 3), 3, metric="mae", **TIGHT
    )
    return cv.averaged.select("alpha", "lambda_idx", rounded("mae", 4).alias("mae"))


EMBEDDED = {"num_lambdas": 10, "lambda_shrink": 0.05, "tol": 1e-13, "max_iter": 2000}


def embedded(spark, sf_dir) -> DataFrame:
    """Whether a vector is of one class, from its 64 components."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", (F.col("label") == 3).cast("double").alias("y"), "embedding")


def tidy_embedded(path) -> DataFrame:
    long = path.select("fold", "alpha", "lambda_idx", "lambda", "intercept", F.posexplode(F.arrays_zip("weights", "beta")).alias("feature", "of"))
    return long.select(
        "fold",
        "alpha",
        "lambda_idx",
        "feature",
        rounded("lambda", 8).alias("lambda"),
        rounded("intercept", 6).alias("intercept"),
        rounded("of.weights", 5).alias("weight"),
        rounded("of.beta", 6).alias("beta"),
    )


@register
def m16_cross_validation_lazy(spark, sf_dir):
    cv = cross_validate(embedded(spark, sf_dir), "y", "embedding", [0.5, 1.0], key_fold("vec_id", 3), 3, mode="lazy", **EMBEDDED)
    averaged = average_metric(cv.metrics, "rmse").join(average_metric(cv.metrics, "r2"), ["cell", "alpha", "lambda_idx"])
    return averaged.select("alpha", "lambda_idx", rounded("rmse", 7).alias("rmse"), rounded("r2", 7).alias("r2"))


@register
def m5_path_lazy_folds(spark, sf_dir):
    path = lazy_path(embedded(spark, sf_dir), "y", "embedding", [0.5, 1.0], fold=key_fold("vec_id", 3), num_folds=3, **EMBEDDED)
    return tidy_embedded(densify(path))


@register
def m11_logistic_embeddings(spark, sf_dir):
    """64 features, of which only active ones are multiplied with each other."""
    path = logistic_path(embedded(spark, sf_dir), "y", "embedding", [0.9], mode="active", **LOGISTIC_TIGHT)
    long = path.select("lambda_idx", "lambda", "beta0", F.posexplode("beta").alias("feature", "b"))
    return long.select(
        "lambda_idx",
        "feature",
        rounded("lambda", 8).alias("lambda"),
        rounded("beta0", 5).alias("beta0"),
        rounded("b", 5).alias("beta"),
    )


@register
def m11_logistic_default_grid(spark, sf_dir):
    """The grid of fixed steps."""
    path = logistic_path(
        labelled_documents(spark, sf_dir), "quality", ["log_size", "blank_share"], [0.8], num_lambdas=30, tol=1e-8, inner_tol=1e-11, max_iter=2000, max_rounds=60
    )
    long = path.select("lambda_idx", "lambda", F.posexplode("weights").alias("feature", "w"))
    return long.select("lambda_idx", "feature", rounded("lambda", 8).alias("lambda"), rounded("w", 5).alias("weight"))


@register
def m16_logistic_cv(spark, sf_dir):
    cv = cross_validate_logistic(
        labelled_documents(spark, sf_dir), "quality", ["log_size", "blank_share"], [0.5, 0.9], key_fold("doc_id", 3), 3, bins=LOGISTIC_BINS, **LOGISTIC_TIGHT
    )
    return cv.metrics.select(
        "fold",
        "alpha",
        "lambda_idx",
        "n",
        rounded("log_loss", 6).alias("log_loss"),
        rounded("accuracy", 6).alias("accuracy"),
        rounded("auc", 4).alias("auc"),
    )


@register
def m16_logistic_cv_best(spark, sf_dir):
    cv = cross_validate_logistic(embedded(spark, sf_dir), "y", "embedding", [0.9], key_fold("vec_id", 3), 3, mode="active", bins=LOGISTIC_BINS, **LOGISTIC_TIGHT)
    model = cv.model.select("lambda_idx", rounded("intercept", 4).alias("intercept"), F.size("indices").cast("int").alias("features"))
    return cv.best.select("alpha", "lambda_idx", rounded("log_loss", 6).alias("log_loss")).join(model, "lambda_idx")


@register
def m16_refit_model(spark, sf_dir):
    return tidy_path(line_cv(spark, sf_dir).model)


@register
def m17_regression_metrics(spark, sf_dir):
    scored = predict(lineitem(spark, sf_dir), FEATURES, FIXED_WEIGHTS, FIXED_INTERCEPT)
    scored = scored.withColumn("fold", key_fold("l_orderkey", 3))
    metrics = regression_metrics(scored, "charge", "prediction", "fold")
    return metrics.select(
        "fold",
        "n",
        rounded("mse", 2).alias("mse"),
        rounded("rmse", 4).alias("rmse"),
        rounded("mae", 4).alias("mae"),
        rounded("r2", 9).alias("r2"),
    )


@register
def m19_differences(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    key = F.col("c_custkey")
    actual = customers.where(key % 7 != 3).withColumn(
        "balance", F.when(key % 11 == 0, F.col("balance") + 0.5).otherwise(F.col("balance") + 1e-9)
    )
    expected = customers.where(key % 13 != 5)
    found = differences(actual, expected, ["c_custkey"], "balance", 1e-6)
    return found.select(
        "c_custkey", rounded("actual", 4).alias("actual"), rounded("expected", 4).alias("expected"), "problem"
    )
