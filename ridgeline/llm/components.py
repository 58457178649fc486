"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with fewer links: each vertex with the smallest of its component."""
    names, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _forests(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        child, root = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(root, pa.int64())], ["u", "v"])


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, root`` for every vertex of ``links`` (long columns ``u``, ``v``): root is its smallest reachable vertex.

    Rounds of two star operations: first every larger neighbour of a vertex is linked to its smallest neighbour, then
    every smaller one. The links left at the end are stars around the roots. A round is a minimum for each vertex,
    reduced before the shuffle, and a join on the vertex, which adaptive execution splits where a vertex has very many
    links; nothing is gathered in one place. Rounds grow with the logarithm of the longest chain. Links with a null
    end and loops are left out; an empty table gives an empty result.
    """
    links = links.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    now = materialize(links.mapInArrow(_forests, "u long, v long").distinct(), "links")
    state = _mark(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "links")
        before, state = state, _mark(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """The same for equal sets of links, and hardly ever for others."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
