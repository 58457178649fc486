"""Held-out sums of all points of many paths, from one pass over the rows.

Points that fit into a broadcast of checked size go to the rows. Beyond that, blocks of rows meet blocks of points of
their fold in tasks of their own: a fold with a third of all rows, or with most of the points, is dealt to more tasks,
and no process ever holds all points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ridgeline.operators.design import Design
from ridgeline.operators.scatter import PACKED, PACKED_CELLS, row_blocks
from ridgeline.session import materialize

POINT_CELLS = 2**20  # nonzero weights, and as many counters, that go to a task together: 8 MB each
ROW_BLOCKS = 64  # blocks of rows (1 MB each) that meet a block of points in one task
KEY = ["fold", "cell", "lambda_idx"]


@dataclass(frozen=True)
class Points:
    """Some points of one fold, with their weights on the features that any of them uses."""

    keys: list[tuple[int, int]]  # cell, index
    intercept: np.ndarray
    features: np.ndarray
    weights: np.ndarray  # features by points

    @classmethod
    def of(cls, rows: list[dict]) -> Points:
        features = np.unique(np.concatenate([np.asarray(r["indices"], dtype=int) for r in rows]))
        weights = np.zeros((len(features), len(rows)))
        for k, r in enumerate(rows):
            weights[np.searchsorted(features, r["indices"]), k] = r["weights"]
        return cls([(r["cell"], r["lambda_idx"]) for r in rows], np.array([r["intercept"] for r in rows]), features, weights)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Rows by points; column 0 of ``rows`` is the label."""
        return rows[:, 1:][:, self.features] @ self.weights + self.intercept


# Sums of some points over some rows: (points, label, margins by point) to one row of numbers for each point.
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sparse_points(path: DataFrame) -> DataFrame:
    """``fold, cell, lambda_idx, intercept, indices, weights`` of the points of held-out folds."""
    if "indices" in path.columns:
        return path.where("fold >= 0").select(*KEY, "intercept", "indices", "weights")
    used = F.filter(F.sequence(F.lit(0), F.size("weights") - 1), lambda i: F.get("weights", i) != 0.0)
    used = F.when(F.size("weights") > 0, used).otherwise(F.array().cast("array<int>"))
    rows = path.where("fold >= 0").select(*KEY, "intercept", used.alias("indices"), "weights")
    return rows.withColumn("weights", F.transform("indices", lambda i: F.get("weights", i)))


def held_out(frame: Design, path: DataFrame, kernel: Kernel, numbers: int) -> DataFrame:
    """``fold, cell, lambda_idx, sums`` (an array of ``numbers``) of every point over the rows of its fold.

    Sums are added up in each task before the shuffle, so a fold of any size is one row for each point and task. A
    point of a fold without rows has no row.
    """
    points = sparse_points(path)
    room = max(1, POINT_CELLS // max(1, numbers // 8))  # counters of a task are bounded too
    cost = F.greatest(F.size("indices") + 1, F.lit(POINT_CELLS // room)).cast("long")
    sizes = points.groupBy("fold").agg(F.sum(cost).alias("cells")).collect()  # one row for each fold
    if sum(r["cells"] for r in sizes) <= POINT_CELLS:
        partials = _sent_to_rows(frame, points, kernel)
    else:
        partials = _met_in_blocks(frame, points.withColumn("cost", cost), kernel)
    return _added_up(partials, numbers)


SUM_SCHEMA = "fold int, cell int, lambda_idx int, sums array<double>"


def _sum_batch(fold: int, points: Points, sums: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
    columns = [pa.array([fold] * len(sums), pa.int32()), *(pa.array(c, pa.int32()) for c in zip(*points.keys))]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(np.ravel(sums)))], [*KEY, "sums"])


def _sent_to_rows(frame: Design, points: DataFrame, kernel: Kernel) -> DataFrame:
    """The points of all folds as a broadcast; its size has been checked."""
    by_fold: dict[int, list[dict]] = {}
    for r in points.collect():
        by_fold.setdefault(r["fold"], []).append(r.asDict())
    sent = frame.rows.sparkSession.sparkContext.broadcast({fold: Points.of(rows) for fold, rows in by_fold.items()})
    columns = frame.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, rows in row_blocks(batch, columns):
                for key in np.unique(fold).astype(int).tolist():
                    if key in sent.value:
                        own = rows[fold == key]
                        sums = kernel(own[:, 0], sent.value[key].margins(own))
                        totals[key] = totals[key] + sums if key in totals else sums
        for key, sums in totals.items():
            yield _sum_batch(key, sent.value[key], sums)

    return frame.rows.mapInArrow(work, SUM_SCHEMA)


def _fold_blocks(frame: Design) -> DataFrame:
    """``fold, number, width, packed``: rows of one fold in binary blocks, stored once."""
    columns = frame.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}

        def block(key: int) -> pa.RecordBatch:
            matrix = np.concatenate(waiting.pop(key))
            matrix = np.column_stack([np.full(len(matrix), float(key)), matrix])
            arrays = [pa.array([key], pa.int32()), pa.array([matrix.shape[1]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["fold", *PACKED])

        for batch in batches:
            for fold, rows in row_blocks(batch, columns):
                step = max(1, PACKED_CELLS // (rows.shape[1] + 1))
                for key in np.unique(fold).astype(int).tolist():
                    own = rows[fold == key]
                    for first in range(0, len(own), step):
                        waiting.setdefault(key, []).append(own[first : first + step])
                        if sum(map(len, waiting[key])) >= step:
                            yield block(key)
        for key in list(waiting):
            yield block(key)

    return materialize(frame.rows.mapInArrow(pack, "fold int, width int, packed binary"), "fold-blocks")


def _met_in_blocks(frame: Design, points: DataFrame, kernel: Kernel) -> DataFrame:
    """Row blocks of a fold with point blocks of that fold, every pair in one of many tasks."""
    rows = _fold_blocks(frame)
    before = Window.partitionBy("fold").orderBy("cell", "lambda_idx").rowsBetween(Window.unboundedPreceding, -1)
    ahead = points.select(*KEY, "cost").withColumn("block", (F.coalesce(F.sum("cost").over(before), F.lit(0)) / POINT_CELLS).cast("int"))
    points = points.drop("cost").join(ahead.drop("cost"), KEY)
    blocks = ahead.groupBy("fold").agg((F.max("block") + 1).alias("blocks"))  # one row for each fold
    salts = rows.groupBy("fold").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCKS).cast("int").alias("salts"))
    plan = blocks.join(salts, "fold")
    dealt = rows.join(plan, "fold").withColumn("salt", F.pmod(F.xxhash64(F.col("packed")), F.col("salts")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("fold", "block", "salt", *PACKED)
    sent = points.join(plan, "fold").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sent = sent.select("fold", "block", "salt", "cell", "lambda_idx", "intercept", "indices", "weights")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_SUMS)
        own = Points.of(right.select(["cell", "lambda_idx", "intercept", "indices", "weights"]).to_pylist())
        total = None
        for batch in left.select(PACKED).to_batches():
            for _, block in row_blocks(batch, PACKED):
                sums = kernel(block[:, 0], own.margins(block))
                total = sums if total is None else total + sums
        return pa.Table.from_batches([_sum_batch(key[0].as_py(), own, total)]).cast(_SUMS)

    by = ["fold", "block", "salt"]
    return dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(meet, SUM_SCHEMA)


_SUMS = pa.schema([("fold", pa.int32()), ("cell", pa.int32()), ("lambda_idx", pa.int32()), ("sums", pa.list_(pa.float64()))])


def _added_up(partials: DataFrame, numbers: int) -> DataFrame:
    """Arrays of a point added up; few numbers as columns in generated code, many as streams of arrays."""
    if numbers <= 8:
        sums = partials.groupBy(*KEY).agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(numbers)])
        return sums.select(*KEY, F.array(*[f"s{i}" for i in range(numbers)]).alias("sums"))

    def add(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(numbers)
        for batch in batches:
            total = total + batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, numbers).sum(axis=0)
        values = pa.ListArray.from_arrays(pa.array([0, numbers], pa.int32()), pa.array(total))
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in keys), values], [*KEY, "sums"])

    from ridgeline.operators.moments import _typed

    return partials.groupBy(*KEY).applyInArrow(_typed(add), SUM_SCHEMA)


# Kernels


def error_sums(label: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """Squared and absolute errors of linear predictions."""
    errors = label[:, None] - margins
    return np.column_stack([(errors * errors).sum(axis=0), np.abs(errors).sum(axis=0)])


MARGIN_RANGE = 16.0  # bins cover margins between minus and plus this; the outer bins take what lies beyond


def score_sums(bins: int) -> Kernel:
    """Rows, positives, log loss and hits of logistic margins, and the positives and negatives of each margin bin."""

    def kernel(label: np.ndarray, margins: np.ndarray) -> np.ndarray:
        points = margins.shape[1]
        loss = np.logaddexp(0.0, margins) - label[:, None] * margins
        hits = (margins > 0.0) == (label[:, None] > 0.5)
        place = np.clip(((margins + MARGIN_RANGE) * (bins / (2 * MARGIN_RANGE))).astype(np.int64), 0, bins - 1)
        place += np.arange(points) * bins
        positive = np.bincount(place.ravel(), np.repeat(label, points), minlength=points * bins).reshape(points, bins)
        every = np.bincount(place.ravel(), minlength=points * bins).reshape(points, bins)
        counts = np.full(points, float(len(label))), np.full(points, label.sum())
        return np.column_stack([*counts, loss.sum(axis=0), hits.sum(axis=0), positive, every - positive])

    return kernel
