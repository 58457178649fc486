"""Choose the mixing weight and penalty by K-fold cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ridgeline.operators.design import Design, design, first_width
from ridgeline.operators.held_out import error_sums, held_out, score_sums
from ridgeline.operators.metrics import average_metric, best_point, fold_metrics
from ridgeline.plans.active_logistic import active_logistic_cells
from ridgeline.plans.lazy import lazy_path
from ridgeline.plans.linear import ALL_ROWS, elastic_net_path
from ridgeline.plans.logistic import FULL_WIDTH, STATE_CELLS, LogisticConfig, full_cells, logistic_design
from ridgeline.session import materialize


@dataclass(frozen=True)
class CrossValidation:
    """Small result tables of one cross-validation."""

    path: DataFrame  # every fold's path, and fold -1 trained on all rows
    metrics: DataFrame  # held-out metrics per fold and grid point
    averaged: DataFrame  # the chosen metric per grid point
    best: DataFrame  # the best grid point
    model: DataFrame  # its path row, trained on all rows


def cross_validate(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    alphas: Sequence[float],
    fold: Column | str,
    num_folds: int,
    metric: str = "rmse",
    **options,
) -> CrossValidation:
    """Fit all folds and the final model from shared moments, and score from held-out moments.

    Penalties are derived per fold, so a grid point is an index; ``shared_lambdas=True`` makes
    it a value. ``metric`` is ``mse``, ``rmse``, ``r2`` or ``mae``. ``mode="lazy"`` is for wide input. It
    and ``mae`` take one more pass, which scores the held-out rows with all points of their fold.
    """
    if metric not in ("mse", "rmse", "r2", "mae"):
        raise ValueError("metric must be mse, rmse, r2 or mae")
    lazy = options.get("mode") == "lazy"
    if lazy:
        wide = {k: v for k, v in options.items() if k != "mode"}
        path = lazy_path(df, label, features, alphas, fold=fold, num_folds=num_folds, **wide)
    else:
        path = elastic_net_path(df, label, features, alphas, fold=fold, num_folds=num_folds, **options)
    path = materialize(path, "path")  # small, and read by every table below
    if lazy or metric == "mae":
        frame = design(df, label, features, fold, options.get("handle_invalid", "error"), num_folds)
        sums = materialize(held_out_sums(frame, path), "held-out")
        scored = path.drop("test_n", "test_sse", "test_sst").join(sums, ["fold", "cell", "lambda_idx"], "left")
        metrics = fold_metrics(scored)
        if metric == "mae":
            mae = sums.select("fold", "cell", "lambda_idx", (F.col("test_sae") / F.col("test_n")).alias("mae"))
            metrics = metrics.join(mae, ["fold", "cell", "lambda_idx"])
    else:
        metrics = fold_metrics(path)
    averaged = average_metric(metrics, metric)
    best = best_point(averaged, metric)
    model = path.where(path["fold"] == ALL_ROWS).join(best.select("cell", "lambda_idx"), ["cell", "lambda_idx"])
    return CrossValidation(path, metrics, averaged, best, model)


def held_out_sums(frame: Design, path: DataFrame) -> DataFrame:
    """``test_n, test_sse, test_sae, test_sst`` of every path point on the rows of its fold, from one pass."""
    errors = held_out(frame, path, error_sums, 2).select(
        "fold", "cell", "lambda_idx", F.col("sums")[0].alias("test_sse"), F.col("sums")[1].alias("test_sae")
    )
    labels = frame.rows.groupBy("fold").agg(F.count(F.lit(1)).alias("test_n"), (F.var_pop("label") * F.count(F.lit(1))).alias("test_sst"))
    return errors.join(labels, "fold")  # one row for a fold


LOGISTIC_METRICS = ("log_loss", "accuracy", "auc")


def cross_validate_logistic(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    alphas: Sequence[float],
    fold: Column | str,
    num_folds: int,
    metric: str = "log_loss",
    bins: int = 1024,
    handle_invalid: str = "error",
    mode: str = "auto",
    **options,
) -> CrossValidation:
    """Fit logistic paths of all folds and of all rows, and score every point on its held-out rows in one more pass.

    ``metric`` is ``log_loss``, ``accuracy`` (probabilities above a half count as class 1) or ``auc``. The area under
    the curve comes from counts of margins in ``bins`` bins between -16 and 16, which tasks add up: a pair of rows in
    one bin counts a half, so ``auc`` is within ``auc_bound`` (half the share of such pairs) of the exact area; both
    are null for a fold of one class. Penalties are derived per fold, so a grid point is an index. Other options are
    those of ``logistic_path``; beyond ``FULL_WIDTH`` features, and with ``mode="active"``, weights stay sparse.
    """
    if metric not in LOGISTIC_METRICS:
        raise ValueError(f"metric must be one of {', '.join(LOGISTIC_METRICS)}")
    configs = [LogisticConfig(alpha=float(a), **options) for a in alphas]
    frame, num_folds = logistic_design(df, label, features, fold, num_folds, handle_invalid)
    if mode == "active" or (mode == "auto" and first_width(frame) > FULL_WIDTH):
        path = active_logistic_cells(frame, configs, num_folds, STATE_CELLS)
    else:
        path = full_cells(frame, configs, num_folds)
    path = materialize(path, "path")  # read by every table below
    sums = materialize(held_out(frame, path, score_sums(bins), 4 + 2 * bins), "held-out")
    metrics = logistic_metrics(path, sums, bins)
    averaged = average_metric(metrics, metric)
    best = best_point(averaged, metric)
    model = path.where(path["fold"] == ALL_ROWS).join(best.select("cell", "lambda_idx"), ["cell", "lambda_idx"])
    return CrossValidation(path, metrics, averaged, best, model)


def logistic_metrics(path: DataFrame, sums: DataFrame, bins: int) -> DataFrame:
    """``fold, cell, alpha, lambda_idx, n, log_loss, accuracy, auc, auc_bound`` of every held-out point."""
    scored = path.where("fold >= 0").select("fold", "cell", "alpha", "lambda_idx").join(sums, ["fold", "cell", "lambda_idx"], "left")
    none = F.raise_error(F.concat(F.lit("no held-out rows in fold "), F.col("fold").cast("string"))).cast("double")
    at = F.col("sums")
    n = F.when(at.isNotNull(), at[0]).otherwise(none)
    positive, negative = F.slice("sums", 5, bins), F.slice("sums", 5 + bins, bins)
    pairs = F.zip_with(positive, negative, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("wins"), F.lit(0.0).alias("ties"))
    # bins rise with the margin: a positive wins over the negatives of the bins below
    area = F.aggregate(
        pairs,
        start,
        lambda t, b: F.struct(
            (t["below"] + b["q"]).alias("below"), (t["wins"] + b["p"] * t["below"]).alias("wins"), (t["ties"] + b["p"] * b["q"]).alias("ties")
        ),
    )
    scored = scored.select("fold", "cell", "alpha", "lambda_idx", n.alias("n"), (at[1] * (at[0] - at[1])).alias("all"), at[2].alias("loss"), at[3].alias("hits"), area.alias("area"))
    return scored.select(
        "fold",
        "cell",
        "alpha",
        "lambda_idx",
        F.col("n").cast("long").alias("n"),
        (F.col("loss") / F.col("n")).alias("log_loss"),
        (F.col("hits") / F.col("n")).alias("accuracy"),
        F.try_divide(F.col("area.wins") + F.col("area.ties") / 2, F.col("all")).alias("auc"),
        F.try_divide(F.col("area.ties") / 2, F.col("all")).alias("auc_bound"),
    )
