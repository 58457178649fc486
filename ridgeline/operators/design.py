"""Normalize training input: one label, and features as columns, an array or a vector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from ridgeline.operators.scatter import PACKED, pack_rows

MAX_PARTIALS = 32768  # upper bound on map tasks, hence on partial results in the shuffle

@dataclass(frozen=True)
class Design:
    """``rows`` has ``fold int, label double`` and then ``x0..`` doubles or one ``features`` array."""

    rows: DataFrame
    names: tuple[str, ...] | None  # None: features is an array whose width the data decides
    packed: bool = False  # rows are binary blocks, see pack()
    known_width: int | None = None  # of an array, once a row has been read

    @property
    def width(self) -> int | None:
        return None if self.names is None else len(self.names)

    @property
    def columns(self) -> list[str]:
        if self.packed:
            return PACKED
        return ["features"] if self.names is None else [f"x{i}" for i in range(len(self.names))]

    def feature_array(self) -> Column:
        return F.col("features") if self.names is None else F.array(*self.columns)

    def flat(self) -> DataFrame:
        """One array per row with the label in slot 0."""
        return self.rows.select("fold", F.concat(F.array("label"), self.feature_array()).alias("row"))


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _checked_fold(fold: Column, num_folds: int | None) -> Column:
    fold = fold.cast("int")
    valid = fold >= 0 if num_folds is None else fold.between(0, num_folds - 1)
    return F.when(valid, fold).otherwise(F.raise_error(F.lit("fold is null or out of range")).cast("int"))


def _checked(value: Column, what: str, handle_invalid: str) -> Column:
    value = value.cast("double")
    if handle_invalid == "skip":
        return value
    return F.when(_finite(value), value).otherwise(F.raise_error(F.lit(f"null, NaN or infinity in {what}")).cast("double"))


def _finite(value: Column) -> Column:
    """True for numbers only; false for null, NaN and infinities."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))  # NaN is above infinity


def design(
    df: DataFrame,
    label: Column | str,
    features: Column | str | Sequence[Column | str],
    fold: Column | str | None = None,
    handle_invalid: str = "error",
    num_folds: int | None = None,
) -> Design:
    """Select and check what a fit reads; everything else is pruned from the scan.

    Fold numbers must be 0 or more, and below ``num_folds`` when that is given. A row without a
    valid fold always fails: leaving it out would change every model.
    """
    if handle_invalid not in ("error", "skip"):
        raise ValueError("handle_invalid must be 'error' or 'skip'")
    key = (F.lit(0) if fold is None else _checked_fold(_as_column(fold), num_folds)).alias("fold")
    target = _checked(_as_column(label), "label", handle_invalid).alias("label")
    if isinstance(features, (str, Column)):
        rows = df.select(key, target, _as_column(features).alias("features"))
        if isinstance(rows.schema["features"].dataType, VectorUDT):
            rows = rows.withColumn("features", vector_to_array("features"))
        rows = rows.withColumn("features", F.col("features").cast("array<double>"))
        names = None
        if handle_invalid == "skip":
            rows = rows.where(F.col("features").isNotNull() & F.forall("features", _finite))
    else:
        names = tuple(f if isinstance(f, str) else f"feature{i}" for i, f in enumerate(features))
        rows = df.select(
            key,
            target,
            *[
                _checked(_as_column(f), names[i], handle_invalid).alias(f"x{i}")
                for i, f in enumerate(features)
            ],
        )
        if handle_invalid == "skip":
            for i in range(len(names)):
                rows = rows.where(_finite(F.col(f"x{i}")))
    if handle_invalid == "skip":
        rows = rows.where(_finite(F.col("label")))
    return Design(rows, names)


def cache_packed(frame: Design) -> tuple[Design, list[DataFrame]]:
    """Cache the rows as binary blocks for work that reads them many times.

    Input with fewer partitions than cores is little data and is spread evenly first; larger
    input keeps the partitions of its scan. Returns the tables to unpersist when done.
    """
    columns = frame.columns

    def pack(batches):
        return pack_rows(batches, columns)

    blocks = frame.rows.coalesce(MAX_PARTIALS).mapInArrow(pack, "width int, packed binary")
    cached = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    held = [cached]
    cores = frame.rows.sparkSession.sparkContext.defaultParallelism
    if cached.rdd.getNumPartitions() < cores:
        spread = cached.repartition(max(1, min(cores, cached.count())))
        held.append(spread.persist(StorageLevel.MEMORY_AND_DISK))
    return Design(held[-1], None, packed=True), held


def first_width(frame: Design) -> int:
    """Number of features, of the first row if it is an array; an empty input has none."""
    if frame.width is not None:
        return frame.width
    if frame.known_width is None:  # one row is read once, however often this is asked
        first = frame.rows.select(F.size("features").alias("width")).first()
        object.__setattr__(frame, "known_width", 0 if first is None else first["width"])
    return frame.known_width
