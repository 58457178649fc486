"""Regression metrics of predictions, and of path points on held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LARGER_IS_BETTER = ("r2", "accuracy", "auc")


def regression_metrics(df: DataFrame, label: Column | str, prediction: Column | str, *by: str) -> DataFrame:
    """``n, mse, rmse, mae, r2`` over the rows, or per key, in one aggregation.

    ``r2`` is null where the label does not vary, as in a group of one row.
    """
    y = F.col(label) if isinstance(label, str) else label
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    rows = df.select(*by, y.alias("y"), (y - p).alias("r"))
    square = F.col("r") * F.col("r")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(square).alias("mse"),
        F.sqrt(F.avg(square)).alias("rmse"),
        F.avg(F.abs("r")).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.avg(square), F.var_pop("y"))).alias("r2"),
    )


def fold_metrics(path: DataFrame) -> DataFrame:
    """Held-out ``mse, rmse, r2`` of every path point, from the sums the cells report.

    A fold without held-out rows fails, since an average over the other folds would hide it; ``r2`` is
    null where the held-out label does not vary.
    """
    none = F.raise_error(F.concat(F.lit("no held-out rows in fold "), F.col("fold").cast("string"))).cast("double")
    mse = F.when(F.col("test_n") > 0, F.col("test_sse") / F.col("test_n")).otherwise(none)
    return path.where("fold >= 0").select(
        "fold",
        "cell",
        "alpha",
        "lambda_idx",
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (F.lit(1.0) - F.try_divide("test_sse", "test_sst")).alias("r2"),
    )


def average_metric(metrics: DataFrame, metric: str = "rmse") -> DataFrame:
    """Mean of a fold metric per grid point."""
    return metrics.groupBy("cell", "alpha", "lambda_idx").agg(F.avg(metric).alias(metric))


def best_point(averaged: DataFrame, metric: str = "rmse", order: tuple[str, ...] = ("cell", "lambda_idx")) -> DataFrame:
    """The best grid point; among equals the first in grid order. One streaming aggregate."""
    score = -F.col(metric) if metric in LARGER_IS_BETTER else F.col(metric)
    row = F.struct(*averaged.columns)
    return averaged.agg(F.min_by(row, F.struct(score, *order)).alias("best")).select("best.*")
