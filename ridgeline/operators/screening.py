"""Which features matter at a point of a path: start set, newcomers, unions, entry order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def start_set(xy: DataFrame, first_lambda: float | str, alpha: float) -> DataFrame:
    """Features whose product with the label exceeds the first threshold."""
    limit = F.col(first_lambda) if isinstance(first_lambda, str) else F.lit(float(first_lambda))
    return xy.where(F.abs("xy") > limit * F.lit(float(alpha)))


def nonzero_features(path: DataFrame, value: str = "beta") -> DataFrame:
    """One row per path point and feature with a nonzero coefficient."""
    keys = [c for c in ("fold", "cell", "alpha", "lambda_idx") if c in path.columns]
    return path.select(*keys, F.posexplode(value).alias("feature", "coefficient")).where("coefficient <> 0")


def _keys(table: DataFrame) -> list[str]:
    """The columns that tell one cell of a path table from another."""
    return [c for c in ("fold", "cell", "alpha") if c in table.columns]


def _numbered(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers rows 0.. within each cell, which has at most one row for a feature."""
    window = Window.partitionBy(*_keys(table)).orderBy(*order)
    return table.withColumn(name, F.row_number().over(window) - 1)


def new_features(coefficients: DataFrame, active: DataFrame) -> DataFrame:
    """Features with a nonzero coefficient that are not active yet in their cell."""
    keys = [c for c in _keys(coefficients) if c in active.columns]
    return coefficients.where("coefficient <> 0").join(active, [*keys, "feature"], "left_anti")


def grow_active_set(active: DataFrame, fresh: DataFrame) -> DataFrame:
    """Per cell the merged list of active features in ascending order, each with its new position."""
    columns = [*_keys(active), "feature"]
    return _numbered(active.select(columns).unionByName(fresh.select(columns)).distinct(), ["feature"], "position")


def ever_active(nonzero: DataFrame) -> DataFrame:
    """Distinct features of each cell that are nonzero anywhere along its path."""
    return nonzero.select(*_keys(nonzero), "feature").dropDuplicates()


def entry_order(nonzero: DataFrame) -> DataFrame:
    """Per cell the features by the first path index at which they are nonzero, ties by feature index."""
    first = nonzero.groupBy(*_keys(nonzero), "feature").agg(F.min("lambda_idx").alias("first_idx"))
    return _numbered(first, ["first_idx", "feature"], "position")
