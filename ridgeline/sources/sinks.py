"""Write and read back result tables: paths, metrics, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_result(table: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Write a result as parquet; many small path rows need no partitioning."""
    writer = table.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
