"""Helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.session import materialize, scratch_path, ship_package

__all__ = ["arrow_map", "bucketed", "documents", "fresh", "materialize", "pack", "shipped_file", "table"]

# Objects that a Python worker builds once from a broadcast, by the digest of what they are built from.
_BUILT: dict[tuple[str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also sends this package to the executors."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name that no given column has, whatever its case."""
    taken = {name.lower() for name in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def pack(frame: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under the operator's own names, so extra columns never clash."""
    return frame.select(*(F.col(f"`{c}`").alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))


BATCH_ROWS = 2048  # rows that Spark hands to Python at once: whole texts, so that a worker's memory stays small
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of a batch; the setting is never raised."""
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def _needs(work: Callable) -> bool:
    return any(isinstance(x, shipped_file) for x in getattr(work, "args", ()))


def forget_built() -> None:
    """Frees what tasks of other operators built in this Python worker, which Spark goes on using."""
    _BUILT.clear()


def arrow_map(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """One output batch for each input batch, columns by position; a task holds one batch at a time."""
    names = schema.names if isinstance(schema, StructType) else None
    builds = _needs(work)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not builds:
            forget_built()
        for batch in source:
            if batch.num_rows:
                out = work(batch)
                yield out.rename_columns(names) if names else out

    ship_package(frame.sparkSession)
    small_batches(frame.sparkSession)
    return frame.toDF(*[f"c{i}" for i in range(len(frame.columns))]).mapInArrow(batches, schema)


def bucketed(rows: DataFrame, column: str) -> DataFrame:
    """Stores rows in the shared folder, dealt out by a column for good, so that joins on it need no shuffle."""
    spark = rows.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.write.format("parquet").option("path", scratch_path(spark, "bucketed")).option("compression", "zstd")
    writer.bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018 - resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


class shipped_file:  # noqa: N801 - reads like a function
    """A small driver-side file as a broadcast; ``build(make)`` gives what a worker makes from it, made once.

    Vocabulary files have a fixed size of a few megabytes, whatever the size of the data.
    """

    LIMIT = 64 << 20

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as source:
            content = source.read()
        if len(content) > self.LIMIT:
            raise ValueError(f"{path} has more than {self.LIMIT} bytes")
        self.digest = hashlib.sha256(content).hexdigest()
        self.content = spark.sparkContext.broadcast(content)

    def build(self, make: Callable[[bytes], object]) -> object:
        key = (self.digest, make.__qualname__)
        if key not in _BUILT:
            _BUILT[key] = make(self.content.value)
        return _BUILT[key]
