"""Tables and progress of a long fit in one shared folder, so that a restarted fit goes on where it stopped."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ridgeline.session import scratch_path

STATE = "state-"


class Journal:
    """A folder for the tables of a fit, and one small state for each finished round.

    A table or state counts once its ``_SUCCESS`` file is there, so what a lost driver left half written is written
    anew. Without a folder of the caller's the fit gets a fresh one, which ``scratch_scope`` deletes.
    """

    def __init__(self, spark: SparkSession, folder: str | None, name: str):
        self.spark = spark
        self.lasting = folder is not None  # nobody goes on with a fit whose folder is its own
        self.folder = (folder or scratch_path(spark, name)).rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, files = self._path(f"{name}/_SUCCESS")
        return files.exists(path)

    def table(self, name: str, make, schema=None) -> DataFrame:
        """The table of that name; ``make()`` gives its rows unless it is there already."""
        where = f"{self.folder}/{name}"
        if not self.has(name):
            rows = make()
            rows.write.mode("overwrite").parquet(where)
            schema = rows.schema
        return self.spark.read.schema(schema).parquet(where) if schema is not None else self.spark.read.parquet(where)

    def tables(self, names: list[str], schema) -> DataFrame:
        """The rows of several tables in one scan."""
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}" for name in names])

    def save(self, number: int, state: dict) -> None:
        if not self.lasting:
            return
        rows = self.spark.range(1, numPartitions=1).select(F.lit(json.dumps(state)).alias("value"))
        rows.write.mode("overwrite").text(f"{self.folder}/{STATE}{number:06d}")

    def last(self, settings: list) -> tuple[int, dict] | None:
        """The last finished round, of a fit with the same settings; a folder of another fit fails."""
        path, files = self._path("")
        if not self.lasting or not files.exists(path):
            return None
        names = sorted((s.getPath().getName() for s in files.listStatus(path)), reverse=True)
        for name in names:
            if name.startswith(STATE) and self.has(name):
                state = json.loads(self.spark.read.text(f"{self.folder}/{name}").first()[0])
                if state["settings"] != json.loads(json.dumps(settings)):
                    raise ValueError(f"{self.folder} holds a fit with other settings")
                return int(name.removeprefix(STATE)), state
        return None
