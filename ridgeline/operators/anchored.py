"""Cross-products of every slot with a few anchor slots, for inputs too wide for a full matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgeline.operators.design import MAX_PARTIALS, Design
from ridgeline.operators.moments import _typed, merge_salts
from ridgeline.operators.scatter import BLOCK_CELLS, row_blocks

ANCHORED_SCHEMA = (
    "fold int, chunk int, start int, n double, anchor_mean array<double>, mean array<double>, "
    "low array<double>, high array<double>, square array<double>, c array<double>"
)
FLUSH_BYTES = 128 << 20  # partials that a map task gathers before it hands them on
_LISTS = ("anchor_mean", "mean", "low", "high", "square", "c")


@dataclass
class Anchored:
    """Slots ``start..``: means, extremes, centred squares and products with the anchors."""

    start: int
    n: float
    anchor_mean: np.ndarray
    mean: np.ndarray
    low: np.ndarray
    high: np.ndarray
    square: np.ndarray
    c: np.ndarray  # anchors by slots

    @classmethod
    def of(cls, rows: np.ndarray, anchors: np.ndarray) -> Anchored:
        mean = rows.mean(axis=0)
        centred = rows - mean
        square = np.einsum("ij,ij->j", centred, centred)
        products = centred[:, anchors].T @ centred
        return cls(0, float(len(rows)), mean[anchors], mean, rows.min(axis=0), rows.max(axis=0), square, products)

    def merge(self, other: Anchored) -> Anchored:
        n = self.n + other.n
        factor = self.n * other.n / n
        shift, anchor_shift = other.mean - self.mean, other.anchor_mean - self.anchor_mean
        return Anchored(
            self.start,
            n,
            self.anchor_mean + anchor_shift * (other.n / n),
            self.mean + shift * (other.n / n),
            np.minimum(self.low, other.low),
            np.maximum(self.high, other.high),
            self.square + other.square + factor * shift**2,
            self.c + other.c + factor * np.outer(anchor_shift, shift),
        )

    def chunks(self, step: int | None = None) -> Iterator[tuple[int, Anchored]]:
        """Cut by slots; with a given ``step`` the chunks of all tables of one input have the same slots."""
        step = step or max(1, BLOCK_CELLS // (len(self.anchor_mean) + 4))
        for number, start in enumerate(range(0, len(self.mean), step)):
            cut = slice(start, start + step)
            yield number, Anchored(
                start,
                self.n,
                self.anchor_mean,
                self.mean[cut],
                self.low[cut],
                self.high[cut],
                self.square[cut],
                self.c[:, cut],
            )

    @property
    def std(self) -> np.ndarray:
        if self.n <= 1:
            return np.zeros(len(self.mean))
        return np.where(self.low == self.high, 0.0, np.sqrt(self.square / (self.n - 1)))


def read_anchored(batch: pa.RecordBatch) -> Iterator[tuple[int, Anchored]]:
    start, n = batch.column("start").to_pylist(), batch.column("n").to_pylist()
    for i in range(batch.num_rows):
        parts = [np.array(batch.column(k)[i].values.to_numpy(), dtype=float) for k in _LISTS]
        parts[-1] = parts[-1].reshape(len(parts[0]), len(parts[1]))
        yield i, Anchored(start[i], n[i], *parts)


def _write(fold: int, chunk: int, item: Anchored) -> pa.RecordBatch:
    arrays = [pa.array([v], pa.int32()) for v in (fold, chunk, item.start)] + [pa.array([item.n], pa.float64())]
    for name in _LISTS:
        values = np.ravel(getattr(item, name))
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values)))
    return pa.RecordBatch.from_arrays(arrays, names=["fold", "chunk", "start", "n", *_LISTS])


def anchored_products(frame: Design, anchors: Sequence[int], step: int | None = None) -> DataFrame:
    """Products of all slots with the anchor slots (0 = label), one row per chunk of slots.

    A map task holds partials of ``FLUSH_BYTES`` besides the one it works on, however many folds there are.
    """
    columns, chosen = frame.columns, np.asarray(list(anchors), dtype=int)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Anchored] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for key, total in totals.items():
                for chunk, item in total.chunks(step):
                    yield _write(key, chunk, item)
            totals.clear()

        for batch in batches:
            for fold, rows in row_blocks(batch, columns):
                for key in np.unique(fold).astype(int).tolist():
                    part = Anchored.of(rows[fold == key], chosen)
                    if key not in totals and totals and 8 * (len(totals) + 1) * part.c.size > FLUSH_BYTES:
                        yield from flushed()
                    totals[key] = totals[key].merge(part) if key in totals else part
        yield from flushed()

    partials = frame.rows.coalesce(MAX_PARTIALS).mapInArrow(partial, ANCHORED_SCHEMA)
    return merge_anchored(partials)


def merge_anchored(partials: DataFrame) -> DataFrame:
    """Add up partials per fold and chunk of slots."""

    def merge(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Anchored | None = None
        for batch in batches:
            for _, part in read_anchored(batch):
                total = part if total is None else total.merge(part)
        yield _write(keys[0].as_py(), keys[1].as_py(), total)

    if (salts := merge_salts(partials)) > 1:
        salted = partials.withColumn("salt", F.spark_partition_id() % salts)
        partials = salted.groupBy("fold", "chunk", "salt").applyInArrow(_typed(merge), ANCHORED_SCHEMA)
    return partials.groupBy("fold", "chunk").applyInArrow(_typed(merge), ANCHORED_SCHEMA)
