"""Cross-products of sparse rows: products of nonzeros only, centring as a rank-one correction.

For standardized columns ``xx_ij = (S_ij - n m_i m_j) / (n s_i s_j)`` with the plain sums ``S_ij`` of products, which
need only the nonzeros that two columns share in a row. A row costs the square of its nonzeros, whatever the number of
columns, and no array is ever as long as that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

PAIRS_AT_ONCE = 1 << 21  # products that a task holds before it adds them up and hands them on
SUM_SCHEMA = "fold int, i int, j int, s double"
COLUMN = -1  # in place of i: the plain sum of column j


def sparse_rows(df: DataFrame, features: str, fold: Column | str | None = None, *others: str) -> DataFrame:
    """``fold, indices, values`` from a vector column, or a struct column with ``indices`` and ``values``; and others."""
    key = (F.lit(0) if fold is None else F.col(fold) if isinstance(fold, str) else fold).cast("int").alias("fold")
    if isinstance(df.schema[features].dataType, VectorUDT):
        rows = df.select(key, F.unwrap_udt(features).alias("v"), *others)
        every = F.when(F.size("v.values") > 0, F.sequence(F.lit(0), F.size("v.values") - 1)).otherwise(F.array().cast("array<int>"))
        indices = F.coalesce("v.indices", every)
    else:
        rows = df.select(key, F.col(features).alias("v"), *others)
        indices = F.col("v.indices").cast("array<int>")
    return rows.select("fold", indices.alias("indices"), F.col("v.values").cast("array<double>").alias("values"), *others)


def _pair_sums(fold: np.ndarray, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of products of the entries of each row with those ``step`` places further on in it, for every step."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((indices, row))
    row, indices, values = row[order], indices[order], values[order]
    if ((row[1:] == row[:-1]) & (indices[1:] == indices[:-1])).any():
        raise ValueError("an index is there twice in a row")
    of, waiting, held = fold[row], [], 0
    waiting.append((of, np.full(len(row), COLUMN), indices, values))
    for step in range(int(np.diff(offsets).max(initial=0))):
        left = np.flatnonzero(row[: len(row) - step] == row[step:])
        right = left + step
        waiting.append((of[left], indices[left], indices[right], values[left] * values[right]))
        held += len(left)
        if held > PAIRS_AT_ONCE:
            yield _added(waiting)
            waiting, held = [], 0
    if waiting:
        yield _added(waiting)


def _added(waiting: list[tuple]) -> pa.RecordBatch:
    fold, i, j, s = (np.concatenate(c) for c in zip(*waiting))
    order = np.lexsort((j, i, fold))
    fold, i, j, s = fold[order], i[order], j[order], s[order]
    first = np.flatnonzero(np.r_[True, (fold[1:] != fold[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(s) else np.zeros(0, int)
    sums = np.add.reduceat(s, first) if len(s) else s
    return pa.RecordBatch.from_arrays([*(pa.array(c[first], pa.int32()) for c in (fold, i, j)), pa.array(sums, pa.float64())], ["fold", "i", "j", "s"])


def pair_sums(rows: DataFrame) -> DataFrame:
    """``fold, i, j, s``: sums of products of columns i <= j that share a row, and column sums under ``i = -1``.

    Null vectors, indices or values, NaN and infinities fail, and so does an index that a row has twice.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(c) for c in ("indices", "values")]
            flat = [c.flatten() for c in lists]
            if any(c.null_count for c in (*lists, *flat, batch.column("fold"))) or not np.isfinite(flat[1].to_numpy()).all():
                raise ValueError("null, NaN or infinity in features or fold")
            sizes = [np.diff(c.offsets.to_numpy()) for c in lists]
            if not np.array_equal(*sizes):
                raise ValueError("indices and values differ in length")
            indices, values = (c.to_numpy() for c in flat)
            used = values != 0.0
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(batch.num_rows), sizes[0])[used], minlength=batch.num_rows))])
            yield from _pair_sums(batch.column("fold").to_numpy(), offsets, indices[used], values[used])

    return rows.mapInArrow(work, SUM_SCHEMA).groupBy("fold", "i", "j").agg(F.sum("s").alias("s"))


def sparse_scales(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """``fold, feature, n, mean, std`` of every column that is not all zero."""
    counts = rows.groupBy("fold").agg(F.count(F.lit(1)).cast("double").alias("n"))
    first = sums.where(F.col("i") == COLUMN).select("fold", F.col("j").alias("feature"), F.col("s").alias("total"))
    second = sums.where("i = j").select("fold", F.col("j").alias("feature"), F.col("s").alias("square"))
    both = first.join(second, ["fold", "feature"]).join(counts, "fold")  # counts: one row per fold
    centred = F.col("square") - F.col("total") * F.col("total") / F.col("n")
    # what rounding leaves of a constant column is no deviation
    spread = F.when(centred <= 1e-12 * F.col("square"), F.lit(0.0)).otherwise(F.sqrt(centred / (F.col("n") - 1)))
    std = F.when(F.col("n") > 1, spread).otherwise(F.lit(0.0))
    return both.select("fold", "feature", "n", (F.col("total") / F.col("n")).alias("mean"), std.alias("std"))


def sparse_gram(df: DataFrame, features: str, fold: Column | str | None = None) -> DataFrame:
    """``fold, i, j, xx``: products of standardized columns i <= j that are both nonzero in some row.

    For other pairs of ``sparse_scales`` the value is ``-mean_i * mean_j / (std_i * std_j)``, which needs no storing.
    Constant columns give 0. An empty table gives an empty result.
    """
    from ridgeline.session import materialize, ship_package

    ship_package(df.sparkSession)
    rows = sparse_rows(df, features, fold)
    sums = materialize(pair_sums(rows), "pair-sums")
    scales = materialize(sparse_scales(rows, sums), "sparse-scales")
    left = scales.select("fold", F.col("feature").alias("i"), "n", F.col("mean").alias("mean_i"), F.col("std").alias("std_i"))
    right = scales.select("fold", F.col("feature").alias("j"), F.col("mean").alias("mean_j"), F.col("std").alias("std_j"))
    pairs = sums.where("i >= 0").join(left, ["fold", "i"]).join(right, ["fold", "j"])
    value = (F.col("s") / F.col("n") - F.col("mean_i") * F.col("mean_j")) / (F.col("std_i") * F.col("std_j"))
    constant = (F.col("std_i") == 0.0) | (F.col("std_j") == 0.0)
    return pairs.select("fold", "i", "j", F.when(constant, F.lit(0.0)).otherwise(value).alias("xx"))
