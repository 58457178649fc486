"""One distributed pass over the rows: per-fold count, means, extremes and cross-products.

Slot 0 is the label and slots 1..p are the features. Two ways give the same table:

* ``columns``: sums of products as SQL aggregates, for a handful of numeric columns;
* ``blocks``: matrix products on Arrow batches, merged band by band in a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgeline.operators.design import MAX_PARTIALS, Design, cache_packed, first_width
from ridgeline.operators.scatter import (
    SCATTER_FIELDS,
    Scatter,
    band_rows,
    read_scatters,
    row_blocks,
    write_scatters,
)
from ridgeline.session import materialize

MOMENT_SCHEMA = "fold int, " + SCATTER_FIELDS
COLUMN_LIMIT = 12  # beyond this many features matrix products on batches are faster
CODEGEN_FIELDS = "spark.sql.codegen.maxFields"
WIDTH_LIMIT = 8192  # a task holds a full matrix up to this (512 MB); wider ones are added up stripe by stripe
FLUSH_BYTES = 512 << 20  # partials that a map task gathers before it hands them on
ONE_LEVEL = 64  # partials that one reducer may add up
ILL_CONDITIONED = 1e4  # |mean| / std above this loses more than 8 digits in plain sums


def moments(frame: Design, mode: str = "auto") -> DataFrame:
    """Per-fold second moments as a small table that no longer depends on the input."""
    if mode not in ("auto", "columns", "blocks"):
        raise ValueError(f"unknown mode {mode!r}")
    by_columns = frame.names is not None and len(frame.names) <= COLUMN_LIMIT
    if mode == "columns" and frame.names is None:
        raise ValueError("mode 'columns' needs a list of feature columns")
    if mode == "columns" and len(frame.names) > 4 * COLUMN_LIMIT:
        raise ValueError(f"mode 'columns' is for {4 * COLUMN_LIMIT} features at most, since one row holds all products: use blocks")
    if mode == "columns" or (mode == "auto" and by_columns):
        return _column_moments(frame)
    width = first_width(frame) + 1
    if width <= WIDTH_LIMIT:
        return materialize(block_moments(frame), "moments")
    # stripes of the matrix, one after another over the same cached rows
    packed, cached = cache_packed(frame)
    try:
        parts = None
        for start, stop in stripes(width):
            own = block_moments(packed, start, stop)
            parts = own if parts is None else parts.unionByName(own)
        return materialize(parts, "moments")
    finally:
        for table in cached:
            table.unpersist()


def stripes(width: int) -> list[tuple[int, int]]:
    """Rows of a matrix too large for a task, in pieces of whole bands within ``FLUSH_BYTES``."""
    step = band_rows(width)
    depth = max(1, FLUSH_BYTES // (8 * width * step)) * step
    return [(start, min(start + depth, width)) for start in range(0, width, depth)]


def _column_sums(frame: Design, shift: np.ndarray) -> list:
    slots = ["label", *frame.columns]
    rows = frame.rows.select(
        "fold", *[(F.col(c) - F.lit(float(s)) if s else F.col(c)).alias(c) for c, s in zip(slots, shift)]
    )
    sums = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(slots):
        sums += [F.sum(a).alias(f"s{i}"), F.min(a).alias(f"low{i}"), F.max(a).alias(f"high{i}")]
        sums += [F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for j, b in enumerate(slots) if j >= i]
    # one row per fold and at most a few hundred numbers per row: safe to hold on the driver
    spark, wide = rows.sparkSession, str(2 * len(sums) + 100)
    # the default of 100 fields would turn off code generation for the whole stage; the setting is only ever
    # raised, so that fits in several threads cannot undo each other
    if int(spark.conf.get(CODEGEN_FIELDS)) < int(wide):
        spark.conf.set(CODEGEN_FIELDS, wide)
    return rows.groupBy("fold").agg(*sums).collect()


def _column_moments(frame: Design) -> DataFrame:
    width = len(frame.columns) + 1
    shift = np.zeros(width)
    records = _column_sums(frame, shift)
    if records:
        n = sum(r["n"] for r in records)
        mean = np.array([sum(r[f"s{i}"] for r in records) / n for i in range(width)])
        square = np.array([sum(r[f"s{i}_{i}"] for r in records) / n for i in range(width)])
        varies = [min(r[f"low{i}"] for r in records) < max(r[f"high{i}"] for r in records) for i in range(width)]
        spread = np.maximum(square - mean**2, 0.0)
        if np.any(varies & (spread * ILL_CONDITIONED**2 < mean**2)):
            shift = mean  # a column sits far from zero: sum again around the means just found
            records = _column_sums(frame, shift)
    parts = []
    for r in records:
        n = float(r["n"])
        total = np.array([r[f"s{i}"] for i in range(width)])
        low, high = (np.array([r[f"{k}{i}"] for i in range(width)]) + shift for k in ("low", "high"))
        square = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                square[i, j] = square[j, i] = r[f"s{i}_{j}"]
        parts.append(Scatter(0, n, total / n + shift, low, high, square - np.outer(total, total) / n))
    batch = write_scatters({"fold": [r["fold"] for r in records]}, [(0, part) for part in parts])
    return frame.rows.sparkSession.createDataFrame(pa.Table.from_batches([batch]), MOMENT_SCHEMA)


def block_moments(frame: Design, start: int = 0, stop: int | None = None) -> DataFrame:
    """Matrix products per Arrow batch, partials of task and fold merged per band; of the matrix only some rows.

    A map task gathers ``FLUSH_BYTES`` at most besides the fold it works on, so many folds hand on partials earlier.
    """
    columns = frame.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, total in gathered(batches, columns, start, stop):
            for block, band in total.blocks():
                yield write_scatters({"fold": [key]}, [(block, band)])

    partials = frame.rows.coalesce(MAX_PARTIALS).mapInArrow(partial, MOMENT_SCHEMA)
    return merge_moments(partials, "fold", MOMENT_SCHEMA)


def gathered(
    batches: Iterator[pa.RecordBatch], columns: list[str], start: int = 0, stop: int | None = None, budget: int | None = None
) -> Iterator[tuple[int, Scatter]]:
    """Moments by fold; all of them are handed on before they would hold more than the budget."""
    budget = FLUSH_BYTES if budget is None else budget
    totals: dict[int, Scatter] = {}
    for batch in batches:
        for fold, rows in row_blocks(batch, columns):
            for key in np.unique(fold).astype(int).tolist():
                part = Scatter.of(rows[fold == key], start, stop)
                if key not in totals and totals and 8 * part.c.size * (len(totals) + 1) > budget:
                    yield from totals.items()
                    totals = {}
                totals[key] = totals[key].merge(part) if key in totals else part
    yield from totals.items()


def merge_moments(partials: DataFrame, key: str, schema: str) -> DataFrame:
    """Add up partial moments per key and band; a reducer holds one band at a time.

    Many partials are added up in two levels, so that a reducer reads about the square root of them.
    """

    def merge(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Scatter | None = None
        for batch in batches:
            for _, part in read_scatters(batch):
                total = part if total is None else total.merge(part)
        yield write_scatters({key: [keys[0].as_py()]}, [(keys[1].as_py(), total)])

    if (salts := merge_salts(partials)) > 1:
        salted = partials.withColumn("salt", F.spark_partition_id() % salts)
        partials = salted.groupBy(key, "block", "salt").applyInArrow(_typed(merge), schema)
    return partials.groupBy(key, "block").applyInArrow(_typed(merge), schema)


def merge_salts(partials: DataFrame) -> int:
    """Groups of a first merge level: the square root of the tasks, or one level for few of them."""
    plan = partials._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "InMemory" in plan:  # counting its tasks would run it
        tasks = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    else:
        tasks = partials.rdd.getNumPartitions()
    return math.isqrt(tasks) if tasks > ONE_LEVEL else 1


def _typed(function):
    """Mark a keyed function as streaming, whatever the module's annotation style."""
    function.__annotations__ = {
        "keys": tuple[pa.Scalar, ...],
        "batches": Iterator[pa.RecordBatch],
        "return": Iterator[pa.RecordBatch],
    }
    return function
