"""Weighted cross-products of one reweighting step, for many coefficient states in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ridgeline.functions import dot, logistic_probability, working_response, working_weight
from ridgeline.functions.scalar import MARGIN_FLOOR, PROBABILITY_GUARD
from ridgeline.operators.moments import _typed
from ridgeline.operators.scatter import BLOCK_CELLS, row_blocks
from ridgeline.operators.standardize import standardize_columns

WEIGHTED_SCHEMA = "cell int, salt int, block int, start int, s array<double>"
SALTS = 32  # ways in which the partials of one band are pre-added when there are many tasks


@dataclass(frozen=True)
class State:
    """Coefficients of one cell, on the common scale ``(x - centre) / spread`` of the kernel."""

    cell: int
    held_out: int  # fold whose rows get weight 0; negative for none
    intercept: float
    slopes: np.ndarray


def weights_and_response(label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row weight and weighted response ``w * z``; the response itself is never divided out."""
    p = 1.0 / (1.0 + np.exp(-np.maximum(margin, MARGIN_FLOOR)))
    low, high = np.abs(p) < PROBABILITY_GUARD, np.abs(1.0 - p) < PROBABILITY_GUARD
    weight = np.where(low | high, PROBABILITY_GUARD, p * (1.0 - p))
    clamped = np.where(low, 0.0, np.where(high, 1.0, p))
    return weight, (label - clamped) + weight * margin


def weighted_partials(
    rows: DataFrame,
    columns: list[str],
    centre: np.ndarray,
    spread: np.ndarray,
    states: Sequence[State],
    salts: int = 1,
) -> DataFrame:
    """``sum w u u'`` and ``sum w u z`` with ``u = [1, v]``: one partial per task and state.

    The last column of every band row is the response.
    """
    states = list(states)
    inverse = np.divide(1.0, spread, out=np.zeros_like(spread), where=spread > 0)
    slopes = np.array([s.slopes for s in states]).reshape(len(states), -1).T
    intercepts = np.array([s.intercept for s in states])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(centre) + 1
        totals = np.zeros((len(states), width, width + 1))
        seen = False
        for batch in batches:
            for fold, rows in row_blocks(batch, columns):
                seen = True
                ones = np.column_stack([np.ones(len(rows)), (rows[:, 1:] - centre) * inverse])
                margins = ones[:, 1:] @ slopes + intercepts
                for k, state in enumerate(states):
                    weight, response = weights_and_response(rows[:, 0], margins[:, k])
                    if state.held_out >= 0:
                        kept = fold != state.held_out
                        weight, response = weight * kept, response * kept
                    totals[k, :, :width] += ones.T @ (ones * weight[:, None])
                    totals[k, :, width] += ones.T @ response
        if not seen:
            return
        context = TaskContext.get()
        salt = context.partitionId() % salts if context else 0
        step = max(1, BLOCK_CELLS // (width + 1))
        for k, state in enumerate(states):
            for block, start in enumerate(range(0, width, step)):
                band = np.ravel(totals[k, start : start + step])
                yield _band_batch(state.cell, salt, block, start, band)

    return rows.mapInArrow(partial, WEIGHTED_SCHEMA)


def _band_batch(cell: int, salt: int, block: int, start: int, band: np.ndarray) -> pa.RecordBatch:
    values = pa.ListArray.from_arrays(pa.array([0, len(band)], pa.int32()), pa.array(band))
    return pa.RecordBatch.from_arrays(
        [pa.array([v], pa.int32()) for v in (cell, salt, block, start)] + [values],
        names=["cell", "salt", "block", "start", "s"],
    )


def add_bands(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    """Sum partial bands by ``(block, start)`` as they stream in."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        block, start = batch.column("block").to_pylist(), batch.column("start").to_pylist()
        bands = batch.column("s")
        for i in range(batch.num_rows):
            key, band = (block[i], start[i]), bands[i].values.to_numpy()
            totals[key] = totals[key] + band if key in totals else np.array(band)
    return totals


def merge_bands(partials: DataFrame) -> DataFrame:
    """Pre-add partials per (cell, salt, block), so that no reducer reads all of them."""

    def merge(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, start), band in add_bands(batches).items():
            yield _band_batch(keys[0].as_py(), keys[1].as_py(), block, start, band)

    return partials.groupBy("cell", "salt", "block").applyInArrow(_typed(merge), WEIGHTED_SCHEMA)


def weighted_products(
    df: DataFrame,
    label: Column | str,
    features: Sequence[Column],
    intercept: float,
    slopes: Sequence[float],
) -> DataFrame:
    """One reweighting step as plain SQL aggregates, tidy ``(i, j, value)``.

    Slot 0 is the constant, slots 1..p the features and slot p + 1 the response.
    """
    y = F.col(label) if isinstance(label, str) else label
    names = [f"x{i + 1}" for i in range(len(features))]
    rows = df.select(y.alias("y"), *[f.alias(n) for f, n in zip(features, names)])
    rows = rows.withColumn("margin", dot(names, slopes, intercept))
    rows = rows.withColumn("p", logistic_probability("margin"))
    rows = rows.select(
        F.lit(1.0).alias("x0"),
        *names,
        working_weight("p").alias("w"),
        working_response("y", "p", "margin").alias(f"x{len(names) + 1}"),
    )
    slots = [f"x{i}" for i in range(len(names) + 2)]
    pairs = [(i, j) for i in range(len(slots) - 1) for j in range(i, len(slots))]
    sums = [F.sum(F.col("w") * F.col(slots[i]) * F.col(slots[j])).alias(f"s{i}_{j}") for i, j in pairs]
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("value")) for i, j in pairs]
    return rows.agg(*sums).select(F.inline(F.array(*entries)))


def start_sums(df: DataFrame, label: Column | str, stats: Mapping[str, tuple[float, float]], label_mean: float) -> DataFrame:
    """Sums over standardized features at the constant model ``p = label_mean``.

    Tidy ``(feature, wxr, wxx, wr, w)``; ``stats`` maps each feature to its mean and deviation.
    """
    y = F.col(label) if isinstance(label, str) else label
    weight = label_mean * (1.0 - label_mean)
    rows = standardize_columns(df.select(y.alias("y"), *stats), stats)
    residual = F.col("y") - F.lit(label_mean)  # w r
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.sum(residual * F.col(c)).alias("wxr"),
            F.sum(F.lit(weight) * F.col(c) * F.col(c)).alias("wxx"),
            F.sum(residual).alias("wr"),
            (F.count(F.lit(1)) * F.lit(weight)).alias("w"),
        ).alias(f"s{i}")
        for i, c in enumerate(stats)
    ]
    return rows.agg(*entries).select(F.inline(F.array(*[f"s{i}" for i in range(len(entries))])))
