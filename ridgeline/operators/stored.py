"""Summaries of the parts of a growing table, stored once and merged when they are needed.

A part is whatever the caller adds at once, such as a day. A refit or a new profile reads the few numbers of the stored
parts and never their rows; a part can be replaced or dropped like a day's partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ridgeline.operators.design import design
from ridgeline.operators.moments import MOMENT_SCHEMA, merge_moments, moments

PROFILE_SCHEMA = "feature string, n long, mean double, m2 double, nnz long, max double, min double, square double, l1 double"


class StoredParts:
    """Small tables of one schema below a folder, one for each part; a part added again replaces the former one."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        path, files = self._path()
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(n.removeprefix("part=") for n in found if n.startswith("part=") and self._whole(n))

    def _whole(self, name: str) -> bool:
        path, files = self._path(f"{name}/_SUCCESS")
        return files.exists(path)

    def put(self, part: str, rows: DataFrame) -> None:
        if not part or any(c in part for c in "/\\="):
            raise ValueError(f"{part!r} is no name for a part")
        rows.write.mode("overwrite").parquet(f"{self.folder}/part={part}")

    def drop(self, part: str) -> None:
        """Takes the part out; a part that is not there is no error."""
        path, files = self._path(f"part={part}")
        files.delete(path, True)

    def rows(self, parts: Sequence[str] | None = None) -> DataFrame:
        """The rows of the named parts, or of all, in one scan."""
        known = self.parts()
        chosen = known if parts is None else list(parts)
        if missing := set(chosen) - set(known):
            raise ValueError(f"no part {sorted(missing)[0]!r}")
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/part={p}" for p in chosen])


class StoredMoments:
    """Moments of a training table by part; paths and cross-validation are fitted from their sum.

    All parts need the same features in the same order; a part of other width fails when it is merged. A row whose
    fold is null or out of range fails the part, as in a fit.
    """

    def __init__(self, spark: SparkSession, folder: str, num_folds: int = 0):
        if num_folds == 1 or num_folds < 0:
            raise ValueError("num_folds must be 0, or at least 2")
        self.store, self.num_folds = StoredParts(spark, folder, MOMENT_SCHEMA), num_folds

    def add(
        self,
        part: str,
        df: DataFrame,
        label: Column | str,
        features: Column | str | Sequence[Column | str],
        fold: Column | str | None = None,
        handle_invalid: str = "error",
    ) -> None:
        """Reads the rows of one part, once."""
        if (fold is None) != (self.num_folds == 0):
            raise ValueError("a fold column is needed with num_folds, and only then")
        frame = design(df, label, features, fold, handle_invalid, self.num_folds or None)
        self.store.put(part, moments(frame))

    def drop(self, part: str) -> None:
        self.store.drop(part)

    def parts(self) -> list[str]:
        return self.store.parts()

    def moments(self, parts: Sequence[str] | None = None) -> DataFrame:
        """Moments of the chosen parts together, band by band."""
        return merge_moments(self.store.rows(parts), "fold", MOMENT_SCHEMA)

    def path(self, alphas: Sequence[float], parts: Sequence[str] | None = None, shared_lambdas: bool = False, **options) -> DataFrame:
        """``elastic_net_path`` of the chosen parts without their rows."""
        from ridgeline.plans.descent import PathConfig
        from ridgeline.plans.linear import solve_cells

        configs = [PathConfig(alpha=float(a), **options) for a in alphas]
        return solve_cells(self.moments(parts), configs, self.num_folds, shared_lambdas)


class StoredProfile:
    """Column profiles by part: counts, means, centred squares, nonzeros, extremes and norms."""

    def __init__(self, spark: SparkSession, folder: str):
        self.store = StoredParts(spark, folder, PROFILE_SCHEMA)

    def add(self, part: str, df: DataFrame, columns: Sequence[str]) -> None:
        """Reads the rows of one part, once. Nulls are left out, as in ``column_profile``."""
        sums = []
        for i, name in enumerate(columns):
            x = F.col(name).cast("double")
            sums.append(
                F.struct(
                    F.lit(name).alias("feature"),
                    F.count(x).alias("n"),
                    F.avg(x).alias("mean"),
                    (F.var_pop(x) * F.count(x)).alias("m2"),
                    F.sum((x != 0).cast("long")).alias("nnz"),
                    F.max(x).alias("max"),
                    F.min(x).alias("min"),
                    F.sum(x * x).alias("square"),
                    F.sum(F.abs(x)).alias("l1"),
                ).alias(f"s{i}")
            )
        self.store.put(part, df.agg(*sums).select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))]))))

    def drop(self, part: str) -> None:
        self.store.drop(part)

    def profile(self, parts: Sequence[str] | None = None) -> DataFrame:
        """``column_profile`` of the chosen parts together; a feature without any value has null statistics."""
        rows = self.store.rows(parts).where("n > 0")
        means = rows.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
        merged = rows.join(means, "feature").groupBy("feature").agg(
            F.sum("n").alias("n"),
            F.first("all_mean").alias("mean"),
            # squares around a part's mean, and of the part's mean around the whole one: nothing large is subtracted
            F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) * (F.col("mean") - F.col("all_mean"))).alias("m2"),
            F.sum("nnz").alias("nnz"),
            F.max("max").alias("max"),
            F.min("min").alias("min"),
            F.sqrt(F.sum("square")).alias("l2"),
            F.sum("l1").alias("l1"),
        )
        spread = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("m2") / (F.col("n") - 1))
        return merged.withColumn("variance", spread).select(
            "feature", "n", "mean", "variance", F.sqrt("variance").alias("std"), "nnz", "max", "min", "l2", "l1"
        )
