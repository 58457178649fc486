"""Session helpers: a tuned session, the shared folder, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "ridgeline", master: str | None = None, **conf) -> SparkSession:
    """Build a session with adaptive execution on; keyword entries use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ridgeline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


_SCOPES = threading.local()  # per thread, the lists of paths of the scopes it is in


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_SCOPES, "open", ()):
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what this thread wrote to fresh paths within it; nothing lazy may outlive it."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    scopes, paths = _SCOPES.open, []
    scopes.append(paths)
    try:
        yield
    finally:
        scopes.pop()
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def materialize(table: DataFrame, name: str) -> DataFrame:
    """Compute a result once into the shared folder and read it from there ever after.

    This cuts the lineage, survives lost executors, and unlike a checkpoint runs the last
    stage only once.
    """
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    context = spark.sparkContext
    if getattr(context, "_ridgeline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # already an archive when installed through --py-files
        archive = os.path.join(tempfile.mkdtemp(prefix="ridgeline-"), "ridgeline.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
    context._ridgeline_shipped = True
