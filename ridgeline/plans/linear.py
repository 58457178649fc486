"""Elastic-net paths of linear models, with cross-validation from the same single pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ridgeline.operators.design import Design, design, first_width
from ridgeline.operators.moments import MOMENT_SCHEMA, WIDTH_LIMIT, _typed, merge_moments, moments
from ridgeline.operators.scatter import Scatter, read_scatters, whole
from ridgeline.plans.descent import PathConfig, PathPoint, lambda_grid, original_scale, scale, solve_path
from ridgeline.session import materialize

ALL_ROWS = -1  # fold number of the cell that trains on every row
NO_ROWS = 2  # role of the record that only says that a cell is wanted
PATH_SCHEMA = (
    "fold int, cell int, alpha double, lambda_idx int, lambda double, intercept double, "
    "weights array<double>, beta array<double>, passes int, converged boolean, n bigint, "
    "test_n bigint, test_sse double, test_sst double"
)


def elastic_net_path(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    alphas: Sequence[float] = (0.01,),
    *,
    fold: Column | str | None = None,
    num_folds: int = 0,
    shared_lambdas: bool = False,
    mode: str = "auto",
    handle_invalid: str = "error",
    **options,
) -> DataFrame:
    """Fit one path per alpha, and with ``fold`` also one per (held-out fold, alpha).

    Fold -1 trains on all rows. Rows of fold k are held out of cell k, and the cell reports
    its squared error on them. ``options`` are the fields of :class:`PathConfig`. With ``mode="auto"``, features from
    ``WIDTH_LIMIT`` on are left to the path of active features.
    """
    configs = [PathConfig(alpha=float(a), **options) for a in alphas]
    if fold is None:
        num_folds = 0
    elif num_folds < 2:
        raise ValueError("num_folds must be at least 2 when a fold column is given")
    frame = design(df, label, features, fold, handle_invalid, num_folds or None)
    if mode == "auto" and first_width(frame) >= WIDTH_LIMIT:
        return active_cells(frame, configs, num_folds, shared_lambdas)
    return solve_cells(moments(frame, mode), configs, num_folds, shared_lambdas)


def active_cells(frame: Design, configs: Sequence[PathConfig], num_folds: int, shared_lambdas: bool) -> DataFrame:
    """The same result for features whose full matrix is too large for a task, by way of active features."""
    from ridgeline.plans.lazy import densify, lazy_cells
    from ridgeline.plans.selection import held_out_sums

    path = lazy_cells(frame, configs, num_folds, shared_lambdas)
    if num_folds:
        sums = materialize(held_out_sums(frame, path).drop("test_sae"), "held-out")
        path = path.join(sums, ["fold", "cell", "lambda_idx"], "left")
    else:
        path = path.withColumns({"test_n": F.lit(None), "test_sse": F.lit(None), "test_sst": F.lit(None)})
    names = [f.split()[0] for f in PATH_SCHEMA.split(", ")]
    kinds = {"test_n": "bigint", "test_sse": "double", "test_sst": "double"}
    return densify(path).select(*[F.col(c).cast(kinds[c]) if c in kinds else c for c in names])


def training_cells(table: DataFrame, num_folds: int, wide: bool) -> DataFrame:
    """Give every fold's moments to the cells that train on it (role 0) or test on it (role 1)."""
    folds = F.sequence(F.lit(ALL_ROWS), F.lit(num_folds - 1)) if num_folds else F.array(F.lit(ALL_ROWS))
    spread = table.withColumnRenamed("fold", "source").withColumn("fold", F.explode(folds))
    role = (F.col("fold") == F.col("source")).cast("int")
    spread = spread.withColumn("role", role)
    if not wide:
        return spread
    # wide matrices: add the training folds up band by band before a cell sees them
    bands = [c.split()[0] for c in MOMENT_SCHEMA.split(", ")]
    train = merge_moments(spread.where("role = 0").select(bands), "fold", MOMENT_SCHEMA)
    return train.withColumn("role", F.lit(0)).unionByName(spread.where("role = 1").select(*bands, "role"))


def solve_cells(
    table: DataFrame,
    configs: Sequence[PathConfig],
    num_folds: int = 0,
    shared_lambdas: bool = False,
) -> DataFrame:
    """Solve all (fold, configuration) cells in parallel, each from a few small records."""
    configs = list(configs)
    spark = table.sparkSession
    wide = num_folds > 0 and not table.isLocal() and _is_wide(table)
    cells = training_cells(table, num_folds, wide)
    numbers = F.array(*[F.lit(i) for i in range(len(configs))])
    # one record without moments for each fold, so that a cell without training rows is there to fail
    folds = F.sequence(F.lit(ALL_ROWS), F.lit(num_folds - 1)) if num_folds else F.array(F.lit(ALL_ROWS))
    named = spark.range(1).select(F.explode(folds).alias("fold"), F.lit(NO_ROWS).alias("role"))
    cells = cells.unionByName(named, allowMissingColumns=True).withColumn("cell", F.explode(numbers))
    tasks = max(1, min((num_folds + 1) * len(configs), 4 * spark.sparkContext.defaultParallelism))

    def solve(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple[int, int], Scatter] = {}
        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column("role"), NO_ROWS))
            role, block = batch.column("role").to_pylist(), batch.column("block").to_pylist()
            for i, part in read_scatters(batch):
                key = (role[i], block[i])
                parts[key] = parts[key].merge(part) if key in parts else part
        train = whole(p for (role, _), p in parts.items() if role == 0)
        test = whole(p for (role, _), p in parts.items() if role == 1)
        fold, cell = keys[0].as_py(), keys[1].as_py()
        if train is None:
            raise ValueError("no rows to train on" + ("" if fold == ALL_ROWS else f" when fold {fold} is held out"))
        yield path_batch(fold, cell, train, test, configs[cell], shared_lambdas)

    spread = cells.repartition(tasks, "fold", "cell")
    return spread.groupBy("fold", "cell").applyInArrow(_typed(solve), PATH_SCHEMA)


def _is_wide(table: DataFrame) -> bool:
    return table.where("block > 0").limit(1).count() > 0


def path_batch(
    fold: int, cell: int, train: Scatter, test: Scatter | None, config: PathConfig, shared: bool
) -> pa.RecordBatch:
    """All path rows of one cell."""
    scaled = scale(train, config.fit_intercept)
    if scaled.std[0] == 0.0:
        # a constant label needs no search: zero weights at every grid entry
        zeros = np.zeros(len(scaled.xy))
        points = [PathPoint(k, float("nan"), zeros, 0, True) for k in range(config.num_lambdas)]
    else:
        base = scale(train.merge(test), config.fit_intercept) if shared and test is not None else scaled
        lambdas = lambda_grid(float(np.abs(base.xy).max()), config)
        points = solve_path(scaled.xy, scaled.xx, lambdas, config)
    rows = []
    for point in points:
        weights, intercept = original_scale(
            point.beta, scaled.mean, scaled.std, config.fit_intercept, scaled.std[0]
        )
        if scaled.std[0] == 0.0:
            intercept = float(scaled.mean[0])
        sse = sst = None
        if test is not None:
            sse, sst = held_out_error(test, weights, intercept), float(test.c[0, 0])
        rows.append(
            {
                "fold": fold,
                "cell": cell,
                "alpha": config.alpha,
                "lambda_idx": point.index,
                "lambda": None if np.isnan(point.lam) else point.lam,
                "intercept": intercept,
                "weights": weights.tolist(),
                "beta": (point.beta + 0.0).tolist(),
                "passes": point.passes,
                "converged": bool(point.converged),
                "n": int(train.n),
                "test_n": None if test is None else int(test.n),
                "test_sse": sse,
                "test_sst": sst,
            }
        )
    return pa.RecordBatch.from_pylist(rows, schema=_PATH_ARROW)


def held_out_error(test: Scatter, weights: np.ndarray, intercept: float) -> float:
    """Sum of squared residuals on the held-out rows, from their moments alone."""
    u = np.concatenate([[1.0], -weights])
    bias = u @ test.mean - intercept
    return float(max(u @ test.c @ u, 0.0) + test.n * bias * bias)


_PATH_ARROW = pa.schema(
    [
        ("fold", pa.int32()),
        ("cell", pa.int32()),
        ("alpha", pa.float64()),
        ("lambda_idx", pa.int32()),
        ("lambda", pa.float64()),
        ("intercept", pa.float64()),
        ("weights", pa.list_(pa.float64())),
        ("beta", pa.list_(pa.float64())),
        ("passes", pa.int32()),
        ("converged", pa.bool_()),
        ("n", pa.int64()),
        ("test_n", pa.int64()),
        ("test_sse", pa.float64()),
        ("test_sst", pa.float64()),
    ]
)
