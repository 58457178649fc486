from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ridgeline.llm.centroids import cluster


def plain(rows, k, rounds, dim):
    """The rounds by plain loops over Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), number) for number, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else c for i, c in enumerate(centroids)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(d for _, _, d in found)
    return [(i, c, d, sum(e for _, o, e in found if o == c), total, digest[c]) for i, c, d in found]


def some_rows():
    rows = [(i, [((i * 37 + j * j * 11 + i * j) % 101 - 50) / 40.0 for j in range(4)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # a hot vector, and a repeated id
    rows += [(1000, rows[7][1]), (None, [0.1, 0.2, 0.3, 0.4])]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [math.nan] * 4), (2005, [math.inf, 0.0, 0.0, 0.0])]
    return rows + odd


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_equal_to_plain_loops(spark, k):
    rows = some_rows()
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, cluster string, x int").repartition(7)
    data = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = cluster(frame, k=k, dim=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(data, k, 3, 4), key=str)


def test_no_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert cluster(frame).count() == 0 and cluster(frame.limit(0)).count() == 0


def test_too_large_components_fail(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        cluster(frame, dim=2).collect()


def test_an_update_reads_changed_components_only(spark):
    """Products kept over the rounds equal products made anew."""
    rows = spark.range(200).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * (j + 1)).cast("float") for j in range(6)]).alias("embedding"))
    got = {r.vec_id: (r.cluster, r.distance) for r in cluster(rows, k=7, rounds=6, dim=6).collect()}
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    assert got == {i: (c, d) for i, c, d, *_ in plain(data, 7, 6, 6)}
