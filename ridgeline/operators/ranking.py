"""Global row numbers without pulling all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ridgeline.session import materialize

_ROW_BITS = 33  # fixed value: monotonically_increasing_id keeps the row in the low 33 bits


def number_rows(table: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows 0.. by ``order``, which must be free of ties.

    Rows are range-partitioned and sorted in parallel; only one count per partition is
    accumulated in a single place. The numbered rows are written out first, so that the counts and
    the rows they number can never come from two different partitionings.
    """
    ranged = materialize(
        table.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()),
        "ranking",
    )
    part = F.shiftright("_id", _ROW_BITS)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, (row + F.col("_before")).cast("int"))
        .drop("_id", "_part", "_before")
    )
