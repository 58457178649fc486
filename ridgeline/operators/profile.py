"""Column statistics in one pass: mean, variance, count, nonzeros, extremes and norms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

TASK_GROUPS = 64


def mean(x: Column) -> Column:
    return F.avg(x)


def variance(x: Column) -> Column:
    """Sample variance; a single row gives 0."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.var_samp(x))


def num_nonzeros(x: Column) -> Column:
    return F.sum((x != 0).cast("long"))


def norm_l2(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def norm_l1(x: Column) -> Column:
    return F.sum(F.abs(x))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tidy profile ``(feature, n, mean, variance, std, nnz, max, min, l2, l1)``, one scan."""
    aggregates = []
    for i, name in enumerate(columns):
        x = F.col(name).cast("double")
        aggregates.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count(x).alias("n"),
                mean(x).alias("mean"),
                variance(x).alias("variance"),
                F.sqrt(variance(x)).alias("std"),
                num_nonzeros(x).alias("nnz"),
                F.max(x).alias("max"),
                F.min(x).alias("min"),
                norm_l2(x).alias("l2"),
                norm_l1(x).alias("l1"),
            ).alias(f"s{i}")
        )
    wide = df.agg(*aggregates)
    return wide.select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def array_profile(df: DataFrame, features: str) -> DataFrame:
    """The same profile for one array or vector column; ``feature`` is the 0-based position.

    The vector summarizer works on whole rows, so no row is exploded per feature. Entries
    that a sparse vector leaves out count as zeros. Summaries are first added up in a fixed
    number of groups of map tasks, so that no reducer receives the partials of all tasks.
    """
    vector = F.col(features)
    if not isinstance(df.schema[features].dataType, VectorUDT):
        vector = array_to_vector(vector.cast("array<double>"))
    wanted = ("mean", "variance", "numNonZeros", "max", "min", "normL2", "normL1")
    rows = df.select(vector.alias("v"), F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS)).alias("part"))
    grouped = rows.where("v is not null").groupBy("part").agg(
        F.count("v").alias("n"), Summarizer.metrics(*wanted).summary(F.col("v")).alias("s")
    )
    parts = [vector_to_array(F.col(f"s.{m}")).alias(m) for m in wanted]
    tall = grouped.select("n", *parts).select("n", F.posexplode(F.arrays_zip(*wanted)).alias("feature", "v"))
    merged = tall.groupBy("feature").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("v.mean")) / F.sum("n")).alias("mean"),
        # at most one entry per group of tasks
        F.collect_list(F.struct("n", "v.mean", "v.variance")).alias("groups"),
        F.sum(F.col("v.numNonZeros")).cast("long").alias("nnz"),
        F.max("v.max").alias("max"),
        F.min("v.min").alias("min"),
        F.sqrt(F.sum(F.col("v.normL2") * F.col("v.normL2"))).alias("l2"),
        F.sum("v.normL1").alias("l1"),
    )
    squares = F.aggregate(
        "groups",
        F.lit(0.0),
        lambda total, g: total
        + (g["n"] - 1) * g["variance"]
        + g["n"] * (g["mean"] - F.col("mean")) * (g["mean"] - F.col("mean")),
    )
    spread = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(squares / (F.col("n") - 1))
    return merged.withColumn("variance", spread).select(
        "feature", "n", "mean", "variance", F.sqrt("variance").alias("std"), "nnz", "max", "min", "l2", "l1"
    )


def label_profile(df: DataFrame, label: Column | str) -> DataFrame:
    """Count, mean and sample deviation of the label."""
    y = F.col(label) if isinstance(label, str) else label
    return df.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.sqrt(variance(y)).alias("std"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))
