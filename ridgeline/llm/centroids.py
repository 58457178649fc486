"""Centroid clustering on exact integers, with dot products that are kept and updated.

Every vector keeps its integer dot product with each centroid. When centroids move, only their nonzero component
changes are multiplied with the vector's components and added, so the products stay exact; a squared distance is then
``|x|^2 - 2 x.c + |c|^2``, and the nearest centroid is an argmin over whole numbers. A round is one narrow pass over a
stored table, and sums of components per cluster, added up in each task before the shuffle, so a cluster that holds a
third of all vectors is no heavier than another. The driver sees one row for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, pack, ship_package

# Components beyond this could make a squared distance too large for a long; they fail the job.
MOST = 2**27
STATE = "x array<long>, norm long, dots array<long>, cluster int, distance long"


def usable(vector: F.Column, dim: int) -> F.Column:
    """True for arrays of ``dim`` components, none null, NaN or infinite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def whole_components(vector: F.Column, scale: int) -> F.Column:
    """``floor(scale * x)`` of each component, taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ravel(matrix)))


def _moved(old: np.ndarray, new: np.ndarray):
    """One narrow pass that takes the products from the old centroids to the new ones."""
    change = new - old
    sizes = (new * new).sum(axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, dots = (_matrix(batch.column(c), batch.num_rows) for c in ("x", "dots"))
            norm, dots = batch.column("norm").to_numpy(), dots.copy()
            for k, by in enumerate(change):
                moved = np.flatnonzero(by)
                if len(moved):
                    dots[:, k] += x[:, moved] @ by[moved]
            distance = norm[:, None] - 2 * dots + sizes
            nearest = distance.argmin(axis=1)  # the first of equals
            least = distance[np.arange(len(x)), nearest]
            columns = [batch.column("id"), batch.column("x"), batch.column("norm"), _lists(dots), pa.array(nearest, pa.int32()), pa.array(least)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "norm", "dots", "cluster", "distance"])

    return work


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 16,
    rounds: int = 3,
    dim: int = 64,
    scale: int = 64,
    seed: str = "1:",
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each usable vector.

    Vectors of another length than ``dim`` and those that are null or hold null, NaN or infinite components have no
    row. Components count as ``floor(scale * x)``; one beyond 2**27 fails the job, since squared distances are longs.
    The first centroids are the ``k`` vectors with the smallest sha256 of ``seed`` and their id; rows with one id are
    ordered by their components, and rows without an id come last. With fewer than ``k`` vectors there are as many
    centroids as vectors. Equal distances go to the smaller number, so repeated vectors share a cluster. An empty
    cluster keeps its centroid. An empty table gives an empty result; other columns are not read.

    Per round one pass reads and one writes ``dim`` plus ``k`` numbers a vector; ``k * dim`` sums reach the driver.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = pack(vectors, id=id_col, vector=vector_col).where(usable(F.col("vector"), dim)).select("id", whole_components(F.col("vector"), scale).alias("x"))
    far = F.exists("x", lambda c: F.abs(c) > MOST)
    rows = rows.withColumn("x", F.when(far, F.raise_error(F.lit("a component is too large")).cast("array<long>")).otherwise(F.col("x")))
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    start = [r["x"] for r in rows.orderBy(order.asc_nulls_last(), "x").limit(k).collect()]
    kind = rows.schema["id"].dataType.simpleString()
    centroids = np.array(start, np.int64).reshape(-1, dim)
    if not len(centroids):
        empty = f"{kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"`{id_col}` {empty}")
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda total, c: total + c * c)
    none = F.array_repeat(F.lit(0).cast("long"), len(centroids))
    state = rows.select("id", "x", norm.alias("norm"), none.alias("dots"))
    old = np.zeros_like(centroids)
    for turn in range(rounds + 1):
        moved = state.select("id", "x", "norm", "dots").mapInArrow(_moved(old, centroids), f"id {kind}, {STATE}")
        state = materialize(moved, "centroids")
        if turn < rounds:
            old, centroids = centroids, _means(state, centroids)
    own = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row for each centroid
    inertia = {r["cluster"]: r["cluster_inertia"] for r in own}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    sums = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    return state.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        F.element_at(sums, at).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"),
    )


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of each cluster's mean; an empty cluster stays."""
    dim = centroids.shape[1]
    sums = [F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(dim)]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{j}"] // row["n"] for j in range(dim)]  # // rounds down
    return out
