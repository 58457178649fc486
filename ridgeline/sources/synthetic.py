"""Synthetic linear tables whose values depend only on row id and seed."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ridgeline.functions import dot
from ridgeline.operators.split import random_split


def _uniform(row_id: Column, stream: int, seed: int) -> Column:
    """Uniform number in [0, 1) from a hash, so a recomputed task yields the same row."""
    bits = F.shiftrightunsigned(F.xxhash64(row_id, F.lit(stream), F.lit(seed)), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def synthetic_rows(
    ids: DataFrame,
    id_column: str,
    num_features: int,
    eps: float = 0.1,
    intercept: float = 0.0,
    seed: int = 12345,
    weights: list[float] | None = None,
) -> DataFrame:
    """Attach ``features`` (uniform, variance 1/3) and a noisy linear ``label`` to given ids."""
    if weights is None:
        draw = random.Random(seed)
        weights = [draw.random() - 0.5 for _ in range(num_features)]
    key = F.col(id_column)
    features = F.array(*[2.0 * _uniform(key, j, seed) - 1.0 for j in range(num_features)])
    rows = ids.select(key, features.alias("features"))
    radius = F.sqrt(-2.0 * F.log(1.0 - _uniform(key, num_features, seed)))
    noise = radius * F.cos(2.0 * math.pi * _uniform(key, num_features + 1, seed))
    return rows.select(
        id_column, (dot("features", weights, intercept) + F.lit(float(eps)) * noise).alias("label"), "features"
    )


def synthetic_linear(
    spark: SparkSession,
    num_rows: int,
    num_features: int,
    eps: float = 0.1,
    intercept: float = 0.0,
    test_fraction: float = 0.2,
    num_partitions: int = 2,
    seed: int = 12345,
) -> tuple[DataFrame, DataFrame]:
    """Generate ``label, features`` and split it into a training and a test table."""
    ids = spark.range(0, num_rows, 1, num_partitions)
    rows = synthetic_rows(ids, "id", num_features, eps, intercept, seed).select("label", "features")
    return random_split(rows, test_fraction, seed)
