"""Standardize columns by their mean and sample deviation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ridgeline.functions import standardize
from ridgeline.operators.profile import variance


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """``{column: (mean, std)}`` from one aggregation; two numbers per column reach the driver."""
    aggregates = []
    for i, name in enumerate(columns):
        x = F.col(name).cast("double")
        # extremes tell a constant column from one whose deviation merely rounds to something tiny
        spread = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.sqrt(variance(x)))
        aggregates += [F.avg(x).alias(f"mean{i}"), spread.alias(f"std{i}")]
    row = df.agg(*aggregates).first()
    return {name: (row[f"mean{i}"], row[f"std{i}"]) for i, name in enumerate(columns)}


def standardize_columns(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Replace the named columns by standardized ones and leave the others as they are.

    A linear fit standardizes label and features, a logistic fit only the features.
    """
    return df.withColumns(
        {name: standardize(F.col(name).cast("double"), mean, std) for name, (mean, std) in stats.items()}
    )
