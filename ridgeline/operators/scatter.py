"""Mergeable centred second moments: the small record that Spark adds up across tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SCATTER_FIELDS = (
    "block int, start int, n double, "
    "mean array<double>, low array<double>, high array<double>, c array<double>"
)
BLOCK_CELLS = 32768  # doubles per shuffled row: 256 KB
PACKED_CELLS = 131072  # doubles per cached block of rows: 1 MB
PACKED = ["width", "packed"]


@dataclass
class Scatter:
    """Rows ``start..`` of ``sum (v - mean)(v - mean)'`` from the diagonal rightwards."""

    start: int
    n: float
    mean: np.ndarray
    low: np.ndarray
    high: np.ndarray
    c: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, start: int = 0, stop: int | None = None) -> Scatter:
        """Moments of some rows; of the matrix only the rows from ``start`` to ``stop``."""
        slots = np.array(rows.T, dtype=float, order="C")  # reductions run along contiguous memory
        mean = slots.mean(axis=1)
        low, high = slots.min(axis=1), slots.max(axis=1)
        slots -= mean[:, None]
        return cls(start, float(len(rows)), mean, low, high, slots[start:stop] @ slots[start:].T)

    def merge(self, other: Scatter) -> Scatter:
        """Pairwise update of count, mean and scatter; no large sums are subtracted."""
        n = self.n + other.n
        shift = other.mean - self.mean
        depth = self.c.shape[0]
        factor = self.n * other.n / n
        across = np.outer(shift[self.start : self.start + depth], shift[self.start :])
        return Scatter(
            self.start,
            n,
            self.mean + shift * (other.n / n),
            np.minimum(self.low, other.low),
            np.maximum(self.high, other.high),
            self.c + other.c + factor * across,
        )

    def blocks(self) -> Iterator[tuple[int, Scatter]]:
        """Cut into row bands, so that reducers share the work; a stripe starts at the first row of a band."""
        step = band_rows(len(self.mean))
        for first in range(0, self.c.shape[0], step):
            band = self.c[first : first + step, first:]
            yield (self.start + first) // step, Scatter(self.start + first, self.n, self.mean, self.low, self.high, band)


def band_rows(width: int) -> int:
    """Rows of the matrix in one shuffled band."""
    return max(1, BLOCK_CELLS // width)


def whole(bands: Iterable[Scatter]) -> Scatter | None:
    """Put row bands back together as one symmetric matrix."""
    bands = list(bands)
    if not bands:
        return None
    first, width = bands[0], len(bands[0].mean)
    full = np.zeros((width, width))
    for band in bands:
        full[band.start : band.start + band.c.shape[0], band.start :] = band.c
    full = np.triu(full)
    full = full + np.triu(full, 1).T
    return Scatter(0, first.n, first.mean, first.low, first.high, full)


def read_scatters(batch: pa.RecordBatch) -> Iterator[tuple[int, Scatter]]:
    """Decode the rows of an Arrow batch as ``(row number, scatter)``."""
    start = batch.column("start").to_numpy()
    n = batch.column("n").to_numpy()
    lists = {k: batch.column(k) for k in ("mean", "low", "high", "c")}
    for i in range(batch.num_rows):
        mean, low, high, c = (
            np.array(lists[k][i].values.to_numpy(), dtype=float) for k in ("mean", "low", "high", "c")
        )
        yield i, Scatter(int(start[i]), float(n[i]), mean, low, high, c.reshape(-1, len(mean) - int(start[i])))


def write_scatters(keys: dict[str, list[int]], items: list[tuple[int, Scatter]]) -> pa.RecordBatch:
    """Encode ``(block, scatter)`` pairs below the given key columns."""

    def lists(name: str) -> pa.Array:
        flat = [np.ravel(getattr(s, name)) for _, s in items]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
        values = np.concatenate(flat) if flat else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))

    data = {k: pa.array(v, pa.int32()) for k, v in keys.items()}
    data["block"] = pa.array([b for b, _ in items], pa.int32())
    data["start"] = pa.array([s.start for _, s in items], pa.int32())
    data["n"] = pa.array([s.n for _, s in items], pa.float64())
    for name in ("mean", "low", "high", "c"):
        data[name] = lists(name)
    return pa.RecordBatch.from_pydict(data)


def feature_matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Features of an Arrow batch as a rows-by-width matrix, from columns or from one array."""
    if columns != ["features"]:
        return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
    column = batch.column("features")
    if column.null_count:
        raise ValueError("null features")
    values = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError(f"feature widths differ: {lengths.min()} and {lengths.max()}")
    matrix = values.to_numpy(zero_copy_only=False)
    if values.null_count or not np.isfinite(matrix).all():
        raise ValueError("null, NaN or infinity in features")
    return matrix.reshape(batch.num_rows, -1)


def row_blocks(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of an Arrow batch as ``(fold, matrix)`` with the label in column 0 of the matrix."""
    if batch.num_rows == 0:
        return
    if columns == PACKED:
        for width, data in zip(batch.column("width").to_pylist(), batch.column("packed")):
            block = np.frombuffer(data.as_buffer(), dtype=np.float64).reshape(-1, width)
            yield block[:, 0], block[:, 1:]
        return
    label = batch.column("label").to_numpy()
    yield batch.column("fold").to_numpy(), np.column_stack([label, feature_matrix(batch, columns)])


def pack_rows(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Turn rows into binary blocks that later passes hand to numpy without decoding."""
    for batch in batches:
        for fold, matrix in row_blocks(batch, columns):
            block = np.column_stack([fold, matrix])
            step = max(1, PACKED_CELLS // block.shape[1])
            pieces = [block[i : i + step].tobytes() for i in range(0, len(block), step)]
            yield pa.RecordBatch.from_pydict(
                {
                    "width": pa.array([block.shape[1]] * len(pieces), pa.int32()),
                    "packed": pa.array(pieces, pa.binary()),
                }
            )
