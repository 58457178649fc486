"""Compare two tables of numbers or texts by key, within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def differences(
    actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float | None = None
) -> DataFrame:
    """Keys that fail: ``missing``, ``unexpected`` or ``differs``; no rows means equal.

    With ``tolerance=None`` the values must be identical, as for texts.
    """
    left = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_in_actual"))
    right = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_in_expected"))
    joined = left.join(right, list(keys), "full_outer")
    same = F.col("actual").eqNullSafe(F.col("expected"))
    if tolerance is not None:
        close = F.abs(F.col("actual") - F.col("expected")) <= F.lit(float(tolerance))
        same = same | F.coalesce(close, F.lit(False))
    problem = (
        F.when(F.col("_in_actual").isNull(), F.lit("missing"))
        .when(F.col("_in_expected").isNull(), F.lit("unexpected"))
        .when(~same, F.lit("differs"))
    )
    return joined.select(*keys, "actual", "expected", problem.alias("problem")).where("problem is not null")


def assert_close(
    actual: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    value: str,
    tolerance: float | None,
    name: str,
) -> None:
    """Raise with the name of the check and its first failing key."""
    worst = differences(actual, expected, keys, value, tolerance).head(1)
    if worst:
        raise AssertionError(f"{name}: {worst[0].asDict()} (tolerance {tolerance})")
