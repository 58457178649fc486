"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard.

Vectors are compared within a label only. Equal vectors are one node with a number of copies. The nodes of a label are
dealt out to shards of bounded size by a hash, and each shard builds its graph. Then every node asks every shard of its
label, in blocks of queries. A search starts narrow. It is widened for queries whose whole beam are links, and for the
whole block until a brute-force audit finds the recall high enough; a beam as wide as the shard is exact. The audit
takes queries until it has seen a number of true links to other nodes, if need be all queries of the block, so a block
never passes on queries without links. Cosines are verified in double precision. A block sends back numbers of links
and a forest of links, not the pairs, and the forests are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_map, materialize, pack
from ridgeline.llm.components import components, forest

SHARD_ROWS = 20_000
BLOCK_ROWS = 1024
DEGREE = 16  # links of a node in an upper layer; twice as many in the lowest
BUILD_WIDTH = 48
FIRST_WIDTH = 64
AUDITED = 64  # queries that are checked by brute force at once
AUDIT_LINKS = 256  # true links to other nodes that end an audit
AUDIT_RECALL = 0.99
SLOT_BLOCKS = 8  # blocks of queries that meet a shard in one task
AT_ONCE = 256
SPREAD = 4  # beam entries expanded in one step, or an eighth of a wide beam
SLACK = 1e-4  # single-precision similarities this far below the limit are still verified


@dataclass
class Graph:
    """Unit vectors, those of the highest layers first, and for each layer the neighbours (-1: none) of its nodes."""

    node: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    layers: list[np.ndarray]  # lowest first; a layer has the first len(layer) vectors

    def __post_init__(self):
        self.single = self.unit.astype(np.float32)

    # ------------------------------------------------------------ search

    def beam(self, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int, among: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ``width`` of the first ``among`` vectors for each query: places (-1: none) and similarities, best first."""
        vectors = self.single
        total = len(queries)
        seen = np.zeros((total, among), bool)
        row = np.arange(total)[:, None]
        valid = start >= 0
        places = np.full((total, width + start.shape[1]), -1)
        likes = np.full(places.shape, -np.inf, np.float32)
        likes[:, width:] = np.where(valid, np.einsum("qsd,qd->qs", vectors[np.maximum(start, 0)], queries), -np.inf)
        places[:, width:] = start
        seen[np.broadcast_to(row, start.shape)[valid], start[valid]] = True
        opened = np.zeros(places.shape, bool)
        keep = np.argsort(-likes, axis=1, kind="stable")[:, :width]
        places, likes, opened = places[row, keep], likes[row, keep], opened[row, keep]
        active = np.arange(total)
        while len(active):
            here = active[:, None]
            todo = np.where(opened[active] | (places[active] < 0), -np.inf, likes[active])
            spread = max(min(SPREAD, width), width // 8)
            pick = np.argpartition(-todo, spread - 1, axis=1)[:, :spread]
            fresh = np.take_along_axis(todo, pick, 1) > -np.inf
            going = fresh.any(axis=1)
            active, here, pick, fresh = active[going], here[going], pick[going], fresh[going]
            if not len(active):
                break
            opened[here, pick] |= fresh
            near = np.where(fresh[:, :, None], links[np.where(fresh, places[here, pick], 0)], -1).reshape(len(active), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[here, np.maximum(near, 0)]
            seen[np.broadcast_to(here, near.shape)[new], near[new]] = True
            at = np.flatnonzero(new.any(axis=0))
            near, new = near[:, at], new[:, at]
            like = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(new)
            like[r, c] = np.einsum("nd,nd->n", vectors[near[r, c]], queries[active[r]])
            both_p = np.concatenate([places[active], np.where(new, near, -1)], 1)
            both_l = np.concatenate([likes[active], like], 1)
            both_o = np.concatenate([opened[active], np.zeros(near.shape, bool)], 1)
            keep = np.argpartition(-both_l, width - 1, axis=1)[:, :width] if both_l.shape[1] > width else np.arange(width)[None].repeat(len(active), 0)
            places[active], likes[active] = np.take_along_axis(both_p, keep, 1), np.take_along_axis(both_l, keep, 1)
            opened[active] = np.take_along_axis(both_o, keep, 1)
        order = np.argsort(-likes, axis=1, kind="stable")
        return np.take_along_axis(places, order, 1), np.take_along_axis(likes, order, 1)

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Where to start in layer ``to``, by going down from the first vector."""
        start = np.zeros((len(queries), 1), np.int64)
        for links in reversed(self.layers[to + 1 :]):
            start = self.beam(links, queries, start, SPREAD, len(links))[0]
        return start

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        return self.beam(self.layers[0], queries, self.descend(queries, 0), min(width, len(self.node)), len(self.node))

    # ------------------------------------------------------------ building

    def choose(self, candidates: np.ndarray, likes: np.ndarray, most: int) -> np.ndarray:
        """Neighbours out of candidates, best first: those nearer to the vector than to one chosen before, then others."""
        vectors = self.single[np.maximum(candidates, 0)]
        between = vectors @ vectors.transpose(0, 2, 1)
        rows, size = candidates.shape
        chosen = np.zeros((rows, size), bool)
        for j in range(size):
            close = np.where(chosen, between[:, j], -np.inf).max(axis=1)
            chosen[:, j] = (candidates[:, j] >= 0) & (likes[:, j] > close) & (chosen.sum(axis=1) < most)
        first = np.argsort(np.where(chosen, 0, np.where(candidates >= 0, 1, 2)) * size + np.arange(size), axis=1)[:, :most]
        out = np.take_along_axis(candidates, first, 1)
        return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)

    def _insert(self, links: np.ndarray, begin: int, end: int, layer: int) -> None:
        """Links vectors begin to end of a layer with those before, and with each other."""
        queries = self.single[begin:end]
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        inner = np.argsort(-among, axis=1)[:, :DEGREE]
        places, likes = inner + begin, np.take_along_axis(among, inner, 1)
        places = np.where(likes > -np.inf, places, -1)
        if begin:
            start = self.descend(queries, layer)
            known, like = self.beam(links, queries, np.where(start < begin, start, -1) if len(self.layers) > layer + 1 else start, min(BUILD_WIDTH, begin), begin)
            places, likes = np.concatenate([places, known], 1), np.concatenate([likes, like], 1)
        order = np.argsort(-np.where(places >= 0, likes, -np.inf), axis=1, kind="stable")[:, : BUILD_WIDTH]
        places, likes = np.take_along_axis(places, order, 1), np.take_along_axis(likes, order, 1)
        most = links.shape[1]
        links[begin:end] = self.choose(places, likes, most // 2 if layer == 0 else most)[:, :most] if layer else np.pad(
            self.choose(places, likes, most // 2), ((0, 0), (0, most - most // 2)), constant_values=-1
        )
        # links back; where there is no room, neighbours are chosen anew
        new, target = np.nonzero(links[begin:end] >= 0)
        target, new = links[begin:end][new, target], new + begin
        order = np.argsort(target, kind="stable")
        target, new = target[order], new[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        room = int(counts.max()) if len(counts) else 0
        for at in range(0, len(nodes), AT_ONCE):
            own, count = nodes[at : at + AT_ONCE], counts[at : at + AT_ONCE]
            extra = np.full((len(own), room), -1)
            r = np.repeat(np.arange(len(own)), count)
            c = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            extra[r, c] = new[starts[at] : starts[at] + len(r)]
            both = np.concatenate([links[own], extra], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            like = np.where(both >= 0, np.einsum("nkd,nd->nk", self.single[np.maximum(both, 0)], self.single[own]), -np.inf)
            order = np.argsort(-like, axis=1, kind="stable")
            both, like = np.take_along_axis(both, order, 1), np.take_along_axis(like, order, 1)
            full = (both >= 0).sum(axis=1) > most
            width = min(both.shape[1], most)
            links[own[~full], :width] = both[~full, :width]
            if full.any():
                links[own[full]] = self.choose(both[full][:, : 2 * most], like[full][:, : 2 * most], most)

    @classmethod
    def build(cls, node: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> Graph:
        """Levels come from the node numbers, so a shard has the same graph whenever it is built."""
        mixed = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        level = np.floor(-np.log(((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / np.log(DEGREE)).astype(int)
        order = np.lexsort((node, -level))
        level = level[order]
        graph = cls(node[order], copies[order], unit[order], [])
        top = int(level[0]) if len(level) else 0
        sizes = [int((level >= i).sum()) for i in range(top + 1)]
        graph.layers = [np.full((size, DEGREE if i else 2 * DEGREE), -1) for i, size in enumerate(sizes)]
        for layer in range(top, -1, -1):
            begin = 0
            while begin < sizes[layer]:
                end = min(sizes[layer], begin + max(64, min(begin // 2, AT_ONCE)))
                graph._insert(graph.layers[layer], begin, end, layer)
                begin = end
        return graph

    def packed(self) -> bytes:
        head = np.array([len(self.node), self.unit.shape[1], len(self.layers), *(len(x) for x in self.layers)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.node, self.copies, self.unit, *(x.astype("<i4") for x in self.layers)))

    @classmethod
    def unpacked(cls, raw: bytes) -> Graph:
        size, wide, layers = np.frombuffer(raw, "<i8", 3)
        counts = np.frombuffer(raw, "<i8", layers, 24)
        at = 24 + 8 * layers
        node, copies = np.frombuffer(raw, "<i8", size, at), np.frombuffer(raw, "<i8", size, at + 8 * size)
        at += 16 * size
        unit = np.frombuffer(raw, "<f8", size * wide, at).reshape(size, wide)
        at += 8 * size * wide
        links = []
        for i, count in enumerate(counts.tolist()):
            degree = DEGREE if i else 2 * DEGREE
            links.append(np.frombuffer(raw, "<i4", count * degree, at).reshape(count, degree).astype(np.int64))
            at += 4 * count * degree
        return cls(node, copies, unit, links)


def audit(graph: Graph, node: np.ndarray, unit: np.ndarray, limit: float) -> tuple[np.ndarray, int]:
    """The queries checked by brute force, spread over the block, and their number of true links to other nodes."""
    spread = np.random.default_rng(len(unit)).permutation(len(unit))
    links, done = 0, 0
    while done < len(unit) and links < AUDIT_LINKS:
        own = spread[done : done + AUDITED]
        true = unit[own] @ graph.unit.T >= limit
        links += int((true & (graph.node != node[own, None])).sum())
        done += len(own)
    return spread[:done], links


def linked(graph: Graph, node: np.ndarray, unit: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of each query to other nodes: (query, place) pairs with a cosine of ``limit`` or more, and the width needed."""
    size = len(graph.node)
    width = min(FIRST_WIDTH, size)
    checked, truth = audit(graph, node, unit, limit)
    while True:
        query, place = _links(graph, unit, limit, width)
        other = graph.node[place] != node[query]
        query, place = query[other], place[other]
        count = np.bincount(query, minlength=len(unit))[checked]
        if width >= size or count.sum() >= AUDIT_RECALL * truth:
            return query, place, width
        width = min(2 * width, size)


def _links(graph: Graph, unit: np.ndarray, limit: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = len(graph.node)
    queries, places = [], []
    todo = np.arange(len(unit))
    while len(todo):
        wider = []
        step = max(8, min(AT_ONCE, (64 << 20) // max(size, 16 * width)))
        for at in range(0, len(todo), step):
            own = todo[at : at + step]
            place, like = graph.search(unit[own], width)
            full = (like[:, -1] >= limit - SLACK) & (width < size)  # perhaps more links than the beam holds
            wider.append(own[full])
            r, c = np.nonzero((like >= limit - SLACK) & (place >= 0) & ~full[:, None])
            exact = np.einsum("nd,nd->n", unit[own[r]], graph.unit[place[r, c]]) >= limit
            queries.append(own[r][exact])
            places.append(place[r, c][exact])
        todo = np.concatenate(wider)
        width = min(4 * width, size)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *queries]), np.concatenate([none, *places])


# ---------------------------------------------------------------- Spark


def _prepare(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Unit vectors in double precision, null where a vector cannot be compared; and a key for equal vectors."""
    units, keys = [], []
    for value in batch.column(2):
        vector = None
        if value.is_valid and len(value) and value.values.null_count == 0:
            vector = np.array(value.values.to_numpy(zero_copy_only=False), np.float64)
            if np.isfinite(vector).all() and vector.any():
                scaled = vector / np.abs(vector).max()  # so that squares neither vanish nor overflow
                vector = scaled / np.sqrt(scaled @ scaled)
            else:
                vector = None
        units.append(None if vector is None else vector.astype("<f8").tobytes())
        keys.append(None if vector is None else hashlib.md5(units[-1]).digest())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], ["vec", "label", "key", "unit"])


def _matrix(column) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), "<f8") for x in column])


def _search_blocks(limit: float, shard: pa.Table, asked: pa.Table) -> pa.Table:
    """A shard's graph and blocks of queries. Gives (node, links) rows and (u, v) rows."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    graph = Graph.unpacked(shard.column("graph")[0].as_py()) if len(asked) else None
    for nodes, units in zip(asked.column("nodes"), asked.column("units")):
        node = np.frombuffer(nodes.as_py(), "<i8")
        unit = np.frombuffer(units.as_py(), "<f8").reshape(len(node), -1)
        query, place, _ = linked(graph, node, unit, limit)
        total = np.bincount(query, weights=graph.copies[place], minlength=len(node)).astype(np.int64)
        child, root = forest(node[query], graph.node[place])
        for column, values in zip(out, (node[total > 0], total[total > 0], child, root)):
            column.append(values)
    node, total, child, root = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
    none = lambda n: pa.nulls(n, pa.int64())
    a, b = len(node), len(child)
    arrays = [pa.concat_arrays([pa.array(x, pa.int64()), none(b)]) for x in (node, total)] + [pa.concat_arrays([none(a), pa.array(x, pa.int64())]) for x in (child, root)]
    return pa.table(arrays, names=["node", "links", "u", "v"])


def embedding_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    limit: float = 0.98,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row: its id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label link at a cosine of ``limit`` or more. ``n_links`` counts the other rows a row links with
    directly, ``component_id`` is the smallest id reached by links, and ``kept`` says whether it is the row's own.
    Vectors that are null, empty or zero, that hold nulls or non-finite numbers, or whose label is null link with
    nothing and keep their own id, as do vectors of other lengths than the compared one. Rows that share an id each
    have a row; a row without id counts as a link but names no component, and is never kept. An empty table gives an
    empty result; other columns are not read.
    """
    rows = pack(vectors, vec=id_col, label=label_col, vector=vector_col)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    base = materialize(arrow_map(rows, _prepare, f"vec {kinds['vec']}, label {kinds['label']}, key binary, unit binary"), "units")
    wide = F.length("unit")
    node = F.when(F.col("label").isNotNull() & F.col("unit").isNotNull(), F.xxhash64("label", "key"))
    marked = base.select("vec", F.struct("label", wide.alias("wide")).alias("group"), "unit", node.alias("node"))
    nodes = marked.where("node is not null").groupBy("group", "node").agg(F.min("vec").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    nodes = materialize(nodes, "vectors")
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes.select("group", F.ceil(F.col("size") / shard_rows).alias("shards"), F.ceil(F.col("size") / block_rows).alias("blocks")), "shards")
    dealt = nodes.join(sizes, "group").select(
        "group", "shards", "node", "copies", "unit",
        F.pmod("node", "shards").alias("shard"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
    )

    def build(table: pa.Table) -> pa.Table:
        graph = Graph.build(table.column("node").to_numpy(), table.column("copies").to_numpy(), _matrix(table.column("unit")))
        return pa.table([table.column("group").slice(0, 1), table.column("shard").slice(0, 1), pa.array([graph.packed()], pa.binary())], names=["group", "shard", "graph"])

    def block(table: pa.Table) -> pa.Table:
        packed = [pa.array([x], pa.binary()) for x in (table.column("node").to_numpy().astype("<i8").tobytes(), b"".join(table.column("unit").to_pylist()))]
        named = [table.column(c).slice(0, 1) for c in ("group", "shards", "block")]
        return pa.table([*named, *packed], names=["group", "shards", "block", "nodes", "units"])

    kind = f"group struct<label: {kinds['label']}, wide: int>"
    graphs = materialize(dealt.select("group", "shard", "node", "copies", "unit").groupBy("group", "shard").applyInArrow(build, f"{kind}, shard long, graph binary"), "graphs")
    blocks = dealt.select("group", "shards", "block", "node", "unit").groupBy("group", "block").applyInArrow(block, f"{kind}, shards long, block long, nodes binary, units binary")
    # a graph is sent once for several blocks, and a shard with many blocks is searched by many tasks
    slot = lambda number: F.floor(number / SLOT_BLOCKS)
    asked = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumn("slot", slot(F.col("block")))
    shards = graphs.join(sizes.select("group", "blocks"), "group").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), slot(F.col("blocks") - 1))))

    def search(shard: pa.Table, asked: pa.Table) -> pa.Table:
        return _search_blocks(limit, shard, asked)

    key = ["group", "shard", "slot"]
    met = shards.select(*key, "graph").groupBy(*key).cogroup(asked.select(*key, "nodes", "units").groupBy(*key))
    found = materialize(met.applyInArrow(search, "node long, links long, u long, v long"), "links")
    roots = components(found.where("u is not null").select("u", "v"))
    counts = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("others"))
    named = nodes.select("node", "low", "copies").join(roots, "node", "left").join(counts, "node", "left")
    least = named.where("root is not null").groupBy(F.col("root").alias("root_")).agg(F.min("low").alias("least"))
    named = named.join(least, F.col("root") == F.col("root_"), "left").select(
        F.col("node").alias("of"),
        F.coalesce("least", "low").alias("component"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    named = materialize(named, "components")
    out = marked.join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec")).otherwise(F.col("component"))
    return out.select(
        F.col("vec").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec") == component, F.lit(False)).alias("kept"),
    )
