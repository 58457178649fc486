"""Delimited labelled text: one row per line, the label first or last, numbers in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def labeled_rows(
    lines: DataFrame,
    delimiter: str = ",",
    label_first: bool = False,
    convert_label: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Split the ``value`` column of a text table into ``label double, features array<double>``."""
    fields = F.split(F.trim("value"), "\\Q" + delimiter + "\\E", -1)
    rows = lines.where(F.length(F.trim("value")) > 0).select(fields.alias("fields"))
    size = F.size("fields")
    text = F.element_at("fields", 1 if label_first else -1)
    label = convert_label(text) if convert_label else text.cast("double")
    start = F.lit(2 if label_first else 1)
    numbers = F.transform(F.slice("fields", start, size - 1), lambda v: F.trim(v).cast("double"))
    return rows.select(label.alias("label"), numbers.alias("features"))


def read_labeled_text(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    label_first: bool = False,
    convert_label: Callable[[Column], Column] | None = None,
    min_partitions: int = 0,
) -> DataFrame:
    """Read labelled text. ``min_partitions`` is a lower bound: a scan with as many splits stays as it is."""
    lines = spark.read.text(path)
    if min_partitions >= 1 and lines.rdd.getNumPartitions() < min_partitions:
        lines = lines.repartition(min_partitions)
    return labeled_rows(lines, delimiter, label_first, convert_label)
