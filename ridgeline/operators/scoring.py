"""Apply path points to rows, and rank weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from ridgeline.functions import dot
from ridgeline.functions.scalar import checked_width
from ridgeline.operators.ranking import number_rows

EXPRESSION_LIMIT = 128  # more weights go through one matrix product per batch, with the same results


def linear_score(
    df: DataFrame, features: str | Sequence[str], weights: Sequence[float], intercept: float
) -> Column:
    """Linear score column: generated code for narrow models, matrix products on Arrow batches for wide ones.

    Both follow ``dot``: null arrays and entries give null, NaN is never hidden, another width fails.
    """
    source: str | Column | Sequence[str] = features
    if isinstance(features, str):
        source = F.col(features)
        if isinstance(df.schema[features].dataType, VectorUDT):
            source = vector_to_array(source)
    if len(weights) <= EXPRESSION_LIMIT:
        return dot(source, weights, intercept)
    if not isinstance(source, Column) and len(source) != len(weights):
        raise ValueError(f"{len(source)} features but {len(weights)} weights")
    array = source if isinstance(source, Column) else F.array(*[F.col(c).cast("double") for c in source])
    array = array.cast("array<double>")
    coefficients = np.asarray(weights, dtype=float)

    def product(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _scores(batch, coefficients, float(intercept))

    product.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(product, "double")(checked_width(array, len(weights), array))


def _scores(features: pa.Array, weights: np.ndarray, intercept: float) -> pa.Array:
    """One matrix product for the rows that have features; a null row or entry gives null."""
    given = features.drop_null()
    values = given.flatten()
    matrix = values.to_numpy(zero_copy_only=False).reshape(len(given), len(weights))
    score = np.full(len(features), np.nan)
    score[features.is_valid().to_numpy(zero_copy_only=False)] = matrix @ weights + intercept
    null = features.is_null().to_numpy(zero_copy_only=False).copy()
    if values.null_count:
        null[~null] = values.is_null().to_numpy(zero_copy_only=False).reshape(matrix.shape).any(axis=1)
    return pa.array(score, pa.float64(), mask=null)


def predict(
    df: DataFrame,
    features: str | Sequence[str],
    weights: Sequence[float],
    intercept: float,
    name: str = "prediction",
) -> DataFrame:
    return df.withColumn(name, linear_score(df, features, weights, intercept))


def residuals(df: DataFrame, label: Column | str, prediction: str = "prediction") -> DataFrame:
    y = F.col(label) if isinstance(label, str) else label
    return df.withColumn("residual", y - F.col(prediction))


def pick_point(path: DataFrame, lambda_idx: int) -> DataFrame:
    """The path rows at one grid index."""
    return path.where(F.col("lambda_idx") == lambda_idx)


def order_of_weights(weights: Column | str) -> Column:
    """0-based feature positions by falling absolute weight; ties keep feature order."""
    weights = F.col(weights) if isinstance(weights, str) else weights
    keyed = F.transform(weights, lambda w, i: F.struct((-F.abs(w)).alias("size"), i.alias("feature")))
    return F.transform(F.array_sort(keyed), lambda k: k["feature"])


def order_of_sparse_weights(path: DataFrame) -> DataFrame:
    """``fold, cell, lambda_idx, feature, weight, position`` of the nonzero weights of paths with ``indices``.

    Positions as in ``order_of_weights``; features of weight zero come after them in feature order and have no row.
    Weights are ranked as rows of one range-partitioned sort, so no point is sorted in one place.
    """
    key = ["fold", "cell", "lambda_idx"]
    entries = path.select(*key, F.explode(F.arrays_zip("indices", "weights")).alias("e"))
    entries = entries.select(*key, F.col("e.indices").alias("feature"), F.col("e.weights").alias("weight")).where("weight <> 0")
    order = [*map(F.col, key), F.abs("weight").desc(), F.col("feature")]
    ranked = number_rows(entries, order, "_rank")
    first = ranked.groupBy(*key).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, key).select(*key, "feature", "weight", (F.col("_rank") - F.col("_first")).alias("position"))


def weights_to_input_scale(
    path: DataFrame,
    stats: DataFrame,
    fit_intercept: bool = True,
    logistic: bool = False,
) -> DataFrame:
    """Turn standardized ``beta`` into ``weights, intercept``.

    ``stats`` is one row per fold with ``mean, std`` arrays, label in slot 0. A linear label was
    standardized too, a logistic one was not and has its own ``beta0``.
    """
    label_std = F.lit(1.0) if logistic else F.element_at("std", 1)
    base = F.col("beta0") if logistic else F.element_at("mean", 1)
    slopes = F.transform(
        F.col("beta"),
        lambda b, i: F.when(F.get("std", i + 1) == 0.0, F.lit(0.0)).otherwise(
            b * label_std / F.get("std", i + 1) + F.lit(0.0)
        ),
    )
    joined = path.drop("weights", "intercept").join(F.broadcast(stats), "fold")  # one row per fold
    scaled = joined.withColumn("weights", slopes)
    pulled = F.aggregate(
        F.zip_with("weights", F.slice("mean", F.lit(2), F.size("weights")), lambda w, m: w * m),
        F.lit(0.0),
        lambda total, v: total + v,
    )
    intercept = base - pulled if (fit_intercept or logistic) else F.lit(0.0)
    return scaled.withColumn("intercept", intercept).drop("mean", "std")
