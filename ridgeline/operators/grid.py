"""Penalty grids and parameter grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.param import Param
from pyspark.sql import DataFrame, functions as F

from ridgeline.plans.descent import GRID_ALPHA_FLOOR

# Fixed value: step of the logistic penalty grid.
LOGISTIC_STEP = 0.93


def penalty_grid(
    top: DataFrame,
    alpha: float,
    num_lambdas: int = 100,
    lambda_shrink: float | None = 1e-3,
    step: float | None = None,
) -> DataFrame:
    """Add ``lambda_idx, lambda`` to rows holding ``top``: ``top / alpha * ratio ** (idx + 1)``."""
    log_ratio = math.log(step) if step else math.log(lambda_shrink) / num_lambdas
    start = F.col("top") / F.lit(max(alpha, GRID_ALPHA_FLOOR))
    indexed = top.withColumn("lambda_idx", F.explode(F.sequence(F.lit(0), F.lit(num_lambdas - 1))))
    return indexed.withColumn("lambda", start * F.exp((F.col("lambda_idx") + 1) * F.lit(log_ratio)))


def logistic_grid(top: DataFrame, alpha: float, num_lambdas: int = 100, step: float = LOGISTIC_STEP) -> DataFrame:
    """Penalty grid with a fixed step."""
    return penalty_grid(top, alpha, num_lambdas, step=step)


def grid_points(alphas: DataFrame, num_lambdas: int) -> DataFrame:
    """Every alpha with every index, by expanding each row rather than by joining."""
    return alphas.select("alpha", F.explode(F.sequence(F.lit(0), F.lit(num_lambdas - 1))).alias("lambda_idx"))


class PathParamGridBuilder:
    """Parameter maps for a path estimator: the added axes outermost, the path index innermost."""

    def __init__(self):
        self._axes: list[tuple[Param, list]] = []

    def addGrid(self, param: Param, values: Sequence) -> PathParamGridBuilder:  # noqa: N802 - Spark ML naming
        self._axes.append((param, list(values)))
        return self

    def build_with_index(self, index: Param, count: int) -> list[dict]:
        maps: list[dict] = [{}]
        for param, values in [*self._axes, (index, list(range(count)))]:
            maps = [{**m, param: v} for m in maps for v in values]
        return maps
