"""Cross-products of standardized rows as tidy tables, derived from the moment table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ridgeline.operators.anchored import anchored_products, read_anchored
from ridgeline.operators.design import Design
from ridgeline.operators.scatter import Scatter, read_scatters

GRAM_SCHEMA = "fold int, i int, j int, value double"


def cross_products(table: DataFrame) -> DataFrame:
    """``(1/n) sum v_i v_j`` over standardized rows, for slot 0 = label and i <= j.

    Each band of the moment table is scaled on its own, so the work and the output are spread
    like the table. Only the diagonal, one small vector per fold, is shared with every band.
    """
    diagonal = table.mapInArrow(_diagonals, "fold int, start int, std array<double>").groupBy("fold")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "std"))), lambda p: p["std"])
    deviations = diagonal.agg(F.flatten(parts).alias("std"))  # p numbers for each fold
    joined = table.join(deviations, "fold")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, stds = batch.column("fold").to_pylist(), batch.column("std")
            for row, band in read_scatters(batch):
                std = np.array(stds[row].values.to_numpy())
                inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
                depth = band.c.shape[0]
                rows = np.arange(band.start, band.start + depth)
                cols = np.arange(band.start, len(std))
                value = band.c * inverse[rows][:, None] * inverse[cols][None, :] / band.n
                i, j = np.meshgrid(rows, cols, indexing="ij")
                keep = i <= j
                yield pa.RecordBatch.from_pydict(
                    {
                        "fold": pa.array(np.full(keep.sum(), folds[row]), pa.int32()),
                        "i": pa.array(i[keep], pa.int32()),
                        "j": pa.array(j[keep], pa.int32()),
                        "value": pa.array(value[keep], pa.float64()),
                    }
                )

    return joined.mapInArrow(scaled, GRAM_SCHEMA)


def _diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(fold, band.start, _band_std(band)) for fold, (_, band) in zip(batch.column("fold").to_pylist(), read_scatters(batch))]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["fold", "start", "std"])


def _band_std(band: Scatter) -> np.ndarray:
    depth = band.c.shape[0]
    rows = slice(band.start, band.start + depth)
    if band.n <= 1:
        return np.zeros(depth)
    spread = np.sqrt(np.maximum(np.diag(band.c), 0.0) / (band.n - 1))
    return np.where(band.low[rows] == band.high[rows], 0.0, spread)


def label_products(products: DataFrame) -> DataFrame:
    """``xy``: the label's cross-product with each 0-based feature."""
    return products.where("i = 0 and j > 0").select(
        "fold", (F.col("j") - 1).alias("feature"), F.col("value").alias("xy")
    )


def direct_label_products(frame: Design) -> DataFrame:
    """``label_products`` without the other pairs: p numbers per fold from one pass, no matrix."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            for row, chunk in read_anchored(batch):
                std = chunk.std
                inverse = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)
                slot = np.arange(chunk.start, chunk.start + len(std))
                # the label's own deviation is in its anchor column of every chunk
                value = chunk.c[0] * inverse / chunk.n
                keep = slot > 0
                yield pa.RecordBatch.from_pydict(
                    {
                        "fold": pa.array(np.full(keep.sum(), folds[row]), pa.int32()),
                        "feature": pa.array(slot[keep] - 1, pa.int32()),
                        "xy": pa.array(value[keep], pa.float64()),
                    }
                )

    products = anchored_products(frame, [0])
    label = products.where("start = 0").select(F.col("fold").alias("of"), "n", F.get("square", F.lit(0)).alias("square"), F.get("low", F.lit(0)).alias("low"), F.get("high", F.lit(0)).alias("high"))
    spread = F.when((F.col("low") == F.col("high")) | (F.col("n") <= 1), F.lit(None)).otherwise(F.sqrt(F.col("square") / (F.col("n") - 1)))
    label = label.select("of", spread.alias("label_std"))
    xy = products.mapInArrow(scaled, "fold int, feature int, xy double")
    joined = xy.join(label, F.col("fold") == F.col("of"))  # one row per fold
    return joined.select("fold", "feature", F.coalesce(F.col("xy") / F.col("label_std"), F.lit(0.0)).alias("xy"))


def feature_products(products: DataFrame) -> DataFrame:
    """``xx``: cross-products of feature pairs i <= j, 0-based."""
    return products.where("i > 0").select(
        "fold", (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("value").alias("xx")
    )


def largest_product(xy: DataFrame) -> DataFrame:
    """Largest absolute ``xy`` per fold, the numerator of the first penalty."""
    return xy.groupBy("fold").agg(F.max(F.abs("xy")).alias("top"))
