"""SimHash near-deduplication with a self-join of binary tries.

Two fingerprints that differ in at most ``bits`` bits agree on at least two of ``bits + 2`` blocks of bits. So each
distinct fingerprint goes to one trie for every pair of blocks, and tries are dealt out by the bits of their pair: a
shuffle of distinct fingerprints, whatever the number of documents that share one. In a trie, node pairs are walked
together from the root down. Differing bits add up, and a pair is left when they exceed the budget, or when both nodes
lie wholly in one component already. Tasks give a forest of links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_map, fresh, materialize, pack
from ridgeline.llm.components import components, forest

WIDTH = 64
SEED = 42
SHINGLES_AT_ONCE = 1 << 20
CHUNK_ROWS = 150_000  # rows a task joins at once
LARGE_TRIE = 60_000  # tries with more fingerprints are walked by several tasks, part against part
SMALL_PAIR = 16  # node pairs with no more leaf pairs are compared leaf by leaf
FRONTIER = 400_000


def fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint of a text as an unsigned number; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(parts))
    starts, ends = starts[: len(parts) - width + 1], ends[width - 1 :]
    hashed = xxhash.xxh64_intdigest
    tally = np.zeros(8 * 256, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        some = slice(at, at + SHINGLES_AT_ONCE)
        tally += _tally(np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[some].tolist(), ends[some].tolist())], "<u8"))
    return _majority(tally, len(starts))


def _tally(hashes: np.ndarray) -> np.ndarray:
    """How often each value of each of the eight bytes is there."""
    return np.bincount((hashes.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=8 * 256)


def _majority(tally: np.ndarray, count: int) -> int:
    bits_of = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    ones = (tally.reshape(8, 256) @ bits_of).ravel()
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes; 0 for none."""
    parts = (hashes[at : at + SHINGLES_AT_ONCE] for at in range(0, len(hashes), SHINGLES_AT_ONCE))
    return _majority(sum((_tally(part) for part in parts), np.zeros(8 * 256, np.int64)), len(hashes))


def _fingerprints(words: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = np.array([fingerprint(value.as_py(), words) for value in batch.column(1)], np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc, print``: the fingerprint of each whole text as a signed long."""
    rows = pack(docs, doc=id_col, text=text_col)
    kind = rows.schema["doc"].dataType.simpleString()
    return arrow_map(rows, partial(_fingerprints, words), f"doc {kind}, print long")


def _split(prints: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where the one-branch of each node begins; nodes are ranges of sorted fingerprints that agree above ``level``."""
    bit = np.uint64(1) << np.uint64(WIDTH - 1 - level)
    below = prints[low] & ~np.uint64((int(bit) << 1) - 1) | bit
    first, last = low.copy(), high.copy()
    while True:  # binary search in all ranges at once
        open_ = first < last
        if not open_.any():
            return first
        middle = (first + last) // 2
        less = np.zeros(len(low), bool)
        less[open_] = prints[middle[open_]] < below[open_]
        first = np.where(open_ & less, middle + 1, first)
        last = np.where(open_ & ~less, middle, last)


class _Walk:
    """The self-join of several tries at once; ``prints`` are sorted within each trie."""

    def __init__(self, prints: np.ndarray, bits: int):
        self.prints, self.bits = prints, bits
        self.label = np.arange(len(prints))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.runs = np.arange(len(prints))  # numbers the stretches of one label

    def run(self, roots: tuple[np.ndarray, ...]) -> None:
        """roots: ranges a and b of node pairs, equal where a trie is joined with itself."""
        a0, a1, b0, b1 = roots
        stack = [(np.zeros(len(a0), np.int64), np.zeros(len(a0), np.int64), a0, a1, b0, b1)]  # level, differing bits
        while stack:
            level, wrong, a0, a1, b0, b1 = stack.pop()
            if len(level) > FRONTIER:
                for at in range(0, len(level), FRONTIER):
                    stack.append(tuple(x[at : at + FRONTIER] for x in (level, wrong, a0, a1, b0, b1)))
                continue
            todo = (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1)) & ~self._joined(a0, a1, b0, b1)
            level, wrong, a0, a1, b0, b1 = (x[todo] for x in (level, wrong, a0, a1, b0, b1))
            small = (a1 - a0) * (b1 - b0) <= SMALL_PAIR
            self._compare(*(x[small] for x in (a0, a1, b0, b1)))
            level, wrong, a0, a1, b0, b1 = (x[~small] for x in (level, wrong, a0, a1, b0, b1))
            if not len(level) or level[0] == WIDTH:
                continue
            depth = int(level[0])  # one level for all node pairs of an entry
            am, bm = _split(self.prints, a0, a1, depth), _split(self.prints, b0, b1, depth)
            same = (a0 == b0) & (a1 == b1)
            sides = [(0, a0, am, b0, bm, None), (0, am, a1, bm, b1, None), (1, a0, am, bm, b1, None), (1, am, a1, b0, bm, ~same)]
            for more, x0, x1, y0, y1, where in sides:
                keep = (wrong + more <= self.bits) & (x1 > x0) & (y1 > y0)
                if where is not None:
                    keep &= where
                if keep.any():
                    stack.append((level[keep] + 1, wrong[keep] + more, x0[keep], x1[keep], y0[keep], y1[keep]))

    def _compare(self, a0, a1, b0, b1) -> None:
        wide = b1 - b0
        count = (a1 - a0) * wide
        if not count.sum():
            return
        pair = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        left, right = a0[pair] + inner // wide[pair], b0[pair] + inner % wide[pair]
        near = (left != right) & (np.bitwise_count(self.prints[left] ^ self.prints[right]) <= self.bits)
        if near.any():
            self.found.append((left[near], right[near]))
            self.waiting += int(near.sum())

    def _joined(self, a0, a1, b0, b1) -> np.ndarray:
        """Node pairs whose leaves are in one component by the links found so far."""
        if self.waiting > len(self.prints) // 4:
            self._settle()
        runs = self.runs
        last_a, last_b = np.maximum(a1 - 1, 0), np.maximum(b1 - 1, 0)
        return (runs[a0] == runs[last_a]) & (runs[b0] == runs[last_b]) & (self.label[a0] == self.label[b0]) & (a1 - a0 + b1 - b0 > 2)

    def _settle(self) -> None:
        if self.found:
            left, right = (np.concatenate(x) for x in zip(*self.found))
            child, root = forest(np.concatenate([left, np.arange(len(self.label))]), np.concatenate([right, self.label]))
            self.label = np.arange(len(self.label))
            self.label[child] = root
            self.found = []
            self.waiting = 0
            self.runs = np.cumsum(np.concatenate([[0], self.label[1:] != self.label[:-1]]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle()
        moved = self.label != np.arange(len(self.label))
        return self.prints[moved], self.prints[self.label[moved]]


def _batch(u, v, trie=None, prints=None, part=None) -> pa.RecordBatch:
    """Links, or fingerprints of a large trie with their part."""
    links, rest = len(u), 0 if prints is None else len(prints)
    none = lambda n: pa.nulls(n, pa.int64())
    put = lambda x: pa.array(np.asarray(x).astype(np.uint64).view(np.int64))
    columns = [(u, None), (v, None), (None, trie), (None, prints), (None, part)]
    arrays = [pa.concat_arrays([put(a) if a is not None else none(links), put(b) if b is not None else none(rest)]) for a, b in columns]
    return pa.RecordBatch.from_arrays(arrays, ["u", "v", "trie", "print", "part"])


def _walk_tries(bits: int, limit: int, chunk: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by trie and fingerprint. A trie over ``limit`` is handed on in parts instead of being walked."""
    trie, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
    handed, part = None, 0  # the large trie being handed on

    def walked(trie: np.ndarray, prints: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))
        ends = np.append(starts[1:], len(trie))
        more = ends - starts > 1
        if more.any():
            walk = _Walk(prints, bits)
            walk.run((starts[more], ends[more], starts[more].copy(), ends[more].copy()))
            u, v = walk.links()
            yield _batch(*forest(u, v))

    for batch in source:
        trie = np.concatenate([trie, batch.column(0).to_numpy()])
        prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
        if len(trie) < chunk and handed is None:
            continue
        while len(trie):
            if handed is not None:
                mine = int(np.searchsorted(trie != handed, True))
                if mine:
                    yield _batch([], [], trie[:mine], prints[:mine], np.full(mine, part))
                    part += 1
                trie, prints = trie[mine:], prints[mine:]
                if not len(trie):
                    break
                handed, part = None, 0
            cut = int(np.flatnonzero(np.concatenate([[True], trie[1:] != trie[:-1]]))[-1])  # the last trie may go on
            if len(trie) - cut > limit:
                handed = trie[cut]
            if cut:
                yield from walked(trie[:cut], prints[:cut])
            trie, prints = trie[cut:], prints[cut:]
            if handed is None:
                break
    if len(trie):
        yield from walked(trie, prints)


def _walk_parts(bits: int, table: pa.Table) -> pa.Table:
    """Two parts of a large trie against each other, or a part with itself."""
    prints = table.column("print").to_numpy().view(np.uint64)
    first = table.column("part").to_numpy() == table.column("i").to_numpy()[0]
    a, b = np.sort(prints[first]), np.sort(prints[~first])
    walk = _Walk(np.concatenate([a, b]), bits)
    ends = (0, len(a), len(a), len(a) + len(b)) if len(b) else (0, len(a), 0, len(a))
    walk.run(tuple(np.array([x]) for x in ends))
    u, v = walk.links()
    return pa.Table.from_batches([_batch(*forest(u, v)).select(["u", "v"])])


def near_fingerprints(prints: DataFrame, bits: int = 4, limit: int = LARGE_TRIE, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints (distinct longs, column ``print``) at ``bits`` or fewer bits.

    Not every near pair has a link of its own, but each is connected by links between near pairs.
    """
    if not 0 <= bits <= 14:
        raise ValueError("bits must be between 0 and 14")
    blocks = bits + 2
    cuts = [round(i * WIDTH / blocks) for i in range(blocks + 1)]
    mask = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    pairs = list(combinations(range(blocks), 2))
    # the trie: the bits of two blocks, hashed with the blocks' numbers; a chance meeting of two tries only costs time
    keys = F.array(*[F.xxhash64(F.lit(i * blocks + j), F.col("print").bitwiseAND(F.lit(signed(mask[i] | mask[j])))) for i, j in pairs])
    rows = prints.select(F.explode(keys).alias("trie"), "print")
    rows = rows.repartition("trie").sortWithinPartitions("trie", F.col("print") < 0, "print")  # unsigned order
    schema = "u long, v long, trie long, print long, part long"
    out = materialize(rows.mapInArrow(partial(_walk_tries, bits, limit, chunk), schema), "near-prints")
    large = out.where("trie is not null").select("trie", "print", "part")
    parts = large.groupBy("trie").agg(F.max("part").alias("last"))
    split = large.join(parts, "trie").select(
        "trie", "print", "part", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    )
    split = split.select("trie", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "print")

    def walked(table: pa.Table) -> pa.Table:
        return _walk_parts(bits, table)

    more = split.groupBy("trie", "i", "j").applyInArrow(walked, "u long, v long")
    return out.where("u is not null").select("u", "v").unionByName(more)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4
) -> DataFrame:
    """Per row: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id linked to it by a chain.

    Fingerprints of ``words``-word shingles of the whole text link at ``bits`` or fewer differing bits. Null, empty and
    blank texts have fingerprint zero, which links like any other. Rows that share an id each have a row; a row without
    id takes part by its text but cannot name a component, so a component of such rows only has a null id. An empty
    table gives an empty result; other columns are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = materialize(marked.groupBy("print").agg(F.min("doc").alias("first")), "distinct-fingerprints")
    linked = materialize(components(near_fingerprints(first.select("print"), bits)), "linked-fingerprints")
    # most fingerprints have no neighbour; only those that do are grouped
    named = first.join(linked, first["print"] == linked["node"]).select("print", "first", "root")
    least = named.groupBy("root").agg(F.min("first").alias("low"))
    named = named.join(least, "root").select(F.col("print").alias("linked"), "low")
    label = first.join(named, F.col("print") == F.col("linked"), "left").select(F.col("print").alias("key"), F.coalesce("low", "first").alias("component_id"))
    # stored, so that both sides of the join are dealt out anew and a fingerprint that very many documents have can be split
    out = marked.join(materialize(label, "fingerprint-labels"), F.col("print") == F.col("key"))
    shown = F.lpad(F.lower(F.hex("print")), 16, "0")
    return out.select(F.col("doc").alias(id_col), shown.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id names their component; rows without id stay. All columns as they were."""
    name = fresh(docs.columns, "kept")
    kept = simhash_components(docs, id_col, text_col, words, bits).where(F.col(f"`{id_col}`") == F.col("component_id"))
    kept = kept.select(F.col(f"`{id_col}`").alias(name)).distinct()
    found = docs.join(kept, F.col(f"`{id_col}`") == F.col(name), "left_semi")
    return found.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
