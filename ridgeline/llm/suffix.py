"""Suffix-array deduplication of repeated byte strings with deep-shallow sorting.

Looked for are all ``width``-byte strings that also start in a document with a smaller id. Each string has an *anchor*:
the ``GRAM``-byte piece in it with the smallest hash, the first of equals. Equal strings have equal anchors at equal
places, so only suffixes that begin near equal anchors have to be sorted against each other.

1. Texts are packed into parts of a few megabytes, stored once and bucketed by part, so no later step moves them.
2. Each part sends the hashes of its anchors, each once, and hears which of them other parts have too.
3. For those, it sends the stretch of text whose strings the anchor stands for. Equal stretches are one for a part.
   Where stretches differ, the suffixes that begin in them are sorted: a lexicographic sort by 8-byte words goes to a
   shallow depth and leaves aside what is alone, then a blind trie orders each group that still agrees. Neighbours that
   agree in all bytes are repeats; the smallest id among them keeps its string.
4. Each part hears which of its strings are repeats and cuts the bytes they cover.

What is shuffled grows with the text, and a string that very many documents share is sent once for each part. An anchor
that more than ``hot_parts`` parts have stands for no stretch: its strings are dealt out one by one, each by its own
hash, so a common piece of text among all kinds of other text does not meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import bucketed, pack
from ridgeline.session import ship_package

GRAM = 20
PART_BYTES = 4 << 20
STEP = 1 << 18
STRINGS = 1 << 17  # strings sorted at once
HOT_PARTS = 256
SLOT_BYTES = 6 << 20  # text whose anchors one reducer takes
SHALLOW_WORDS = 3
BITS = 48
NO_ID = np.iinfo(np.int64).max  # rows without id come after all others


# ---------------------------------------------------------------- sorting


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order of equally long strings, and the class of each: equal strings share one.

    Inner nodes hold only the place where their strings differ first. A string goes down by those places alone, is
    compared with the leaf it comes to, and branches off where the two differ.
    """
    members: list[list[int]] = [[0]]
    root: object = 0  # a class, or [place, {byte: node}]
    for at in range(1, len(strings)):
        text = strings[at]
        node = root
        while not isinstance(node, int):
            node = node[1].get(text[node[0]], next(iter(node[1].values())))
        other = strings[members[node][0]]
        if other == text:
            members[node].append(at)
            continue
        place = next(i for i, (x, y) in enumerate(zip(text, other)) if x != y)
        own = len(members)
        members.append([at])
        above, node = None, root
        while not isinstance(node, int) and node[0] < place:
            above, node = (node, text[node[0]]), node[1][text[node[0]]]
        if not isinstance(node, int) and node[0] == place:
            node[1][text[place]] = own
            continue
        branch = [place, {other[place]: node, text[place]: own}]
        if above is None:
            root = branch
        else:
            above[0][1][above[1]] = branch
    order: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            order += members[node]
        else:
            stack += [node[1][byte] for byte in sorted(node[1], reverse=True)]
    kind = [0] * len(strings)
    for number, own in enumerate(members):
        for at in own:
            kind[at] = number
    return order, kind


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorts suffixes (equally long rows of bytes) within groups; yields classes of two or more equal suffixes.

    Given are their places in ``rows``, and the number of the class of each. Suffixes that are alone in their group or
    differ from all others leave the sort as soon as that shows.
    """
    width = rows.shape[1]
    here = np.arange(len(group))
    segment = group
    for depth in range(-1, SHALLOW_WORDS):
        if depth >= 0:
            if 8 * (depth + 1) > width:
                break
            word = np.ascontiguousarray(rows[here, 8 * depth : 8 * depth + 8]).view(">u8").ravel()
            order = np.lexsort((word, segment))
            here, segment, word = here[order], segment[order], word[order]
            new = (segment[1:] != segment[:-1]) | (word[1:] != word[:-1])
        else:
            order = np.argsort(segment, kind="stable")
            here, segment = here[order], segment[order]
            new = segment[1:] != segment[:-1]
        number = np.cumsum(np.concatenate([[0], new])) if len(here) else np.empty(0, np.int64)
        more = np.bincount(number)[number] > 1 if len(here) else np.empty(0, bool)
        here, segment = here[more], number[more]
    if not len(here):
        return
    deep = min(8 * SHALLOW_WORDS, width // 8 * 8)
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sizes = np.diff(np.append(starts, len(here)))
    pair = starts[sizes == 2]  # a trie of two leaves
    if len(pair):
        a, b = here[pair], here[pair + 1]
        same = (rows[a, deep:] == rows[b, deep:]).all(axis=1)
        both = np.stack([a[same], b[same]], 1)
        if len(both):
            yield both.ravel(), np.repeat(np.arange(len(both)), 2)
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = here[start : start + size]
        _, kind = blind_trie([row.tobytes() for row in rows[own, deep:]])
        kind = np.array(kind)
        often = np.bincount(kind)[kind] > 1
        if often.any():
            yield own[often], kind[often]


# ---------------------------------------------------------------- anchors


@dataclass
class Anchors:
    """Anchors of a part: the first string each stands for, how many, its place in the first, its hash, its document."""

    first: np.ndarray
    count: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    count = len(data) - GRAM + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view("<u8").ravel()
    mixed = words[:count] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= words[8 : 8 + count] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(31)
    mixed += words[GRAM - 8 : GRAM - 8 + count] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _first_least(values: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` values, where its least value is, the first of equals."""
    at = np.arange(len(values), dtype=np.int64)
    covered = 1
    while covered < span:
        step = min(covered, span - covered)
        size = len(values) - step
        left = values[:size] <= values[step:]
        values, at = np.where(left, values[:size], values[step:]), np.where(left, at[:size], at[step:])
        covered += step
    return at


def find_anchors(data: np.ndarray, ends: np.ndarray, width: int) -> Anchors:
    """Anchors of all ``width``-byte strings that lie within one document; ``ends`` are where documents end."""
    found = []
    for start in range(0, max(len(data) - width + 1, 0), STEP):
        piece = data[start : start + STEP + width - 1]
        hashes = _gram_hashes(piece)
        at = _first_least(hashes, width - GRAM + 1)
        string = np.arange(len(at))
        # a string is whole if its first and last byte are in one document
        near = ends[(ends > start) & (ends < start + len(piece))] - start
        broken = np.zeros(len(piece) + 1, np.int64)
        np.add.at(broken, np.maximum(near - width + 1, 0), 1)
        np.add.at(broken, near, -1)
        whole = np.cumsum(broken[:-1])[: len(at)] == 0
        string, at = string[whole], at[whole]
        if not len(string):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (string[1:] != string[:-1] + 1)])
        first = string[new]
        count = np.diff(np.append(np.flatnonzero(new), len(string)))
        anchor = at[new]
        even = hashes[anchor]  # the least of many: small numbers, which are spread out anew
        even = (even ^ even >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
        even = (even ^ even >> np.uint64(27)) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((first + start, count, anchor - first, even >> np.uint64(64 - BITS)))
    if not found:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, none.astype(np.uint64), none)
    first, count, place, hashes = (np.concatenate(x) for x in zip(*found))
    return Anchors(first, count, place, hashes, np.searchsorted(ends, first, side="right"))


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(BITS - 24)).astype(np.int64) * slots >> 24


def _by_slot(hashes: np.ndarray, slots: int) -> Iterator[tuple[int, slice]]:
    """Sorted hashes, cut by slot."""
    slot = _slots(hashes, slots)
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else []
    for start, end in zip(starts, np.append(starts[1:], len(slot)) if len(starts) else []):
        yield int(slot[start]), slice(start, end)


def _packed(hashes: np.ndarray) -> bytes:
    """48-bit numbers in 6 bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8")[:, None].view(np.uint8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# ---------------------------------------------------------------- steps


def _pack_parts(part_bytes: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task, packed into parts in the order they come."""
    context = TaskContext.get()
    part = (context.partitionId() if context else 0) << 32
    texts: list[bytes] = []
    ids: list[int | None] = []
    size = 0

    def packed() -> pa.RecordBatch:
        arrays = [
            pa.array([part], pa.int64()),
            pa.array([b"".join(texts)], pa.large_binary()).cast(pa.binary()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([np.cumsum([len(t) for t in texts])], pa.list_(pa.int64())),
            pa.array([size], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["part", "data", "ids", "ends", "size"])

    for batch in source:
        for number, text in zip(batch.column(0), batch.column(1)):
            raw = (text.as_py() or "").encode()
            if texts and size + len(raw) > part_bytes:
                yield packed()
                part += 1
                texts, ids, size = [], [], 0
            texts.append(raw)
            ids.append(number.as_py())
            size += len(raw)
    if texts:
        yield packed()


@dataclass
class Part:
    """A part with its anchors, as each step makes them anew."""

    data: np.ndarray
    ids: list[int | None]
    rank: np.ndarray  # ids to compare by
    ends: np.ndarray
    anchors: Anchors

    @classmethod
    def of(cls, row: dict, width: int) -> Part:
        data = np.frombuffer(row["data"], np.uint8)
        ends = np.array(row["ends"], np.int64)
        rank = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        return cls(data, row["ids"], rank, ends, find_anchors(data, ends, width))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors, each once, and whether two documents of the part have it."""
        rank = self.rank[self.anchors.doc]
        order = np.lexsort((rank, self.anchors.hash))
        hashes, rank = self.anchors.hash[order], rank[order]
        if not len(hashes):
            return hashes, np.empty(0, bool)
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        last = np.append(starts[1:], len(hashes)) - 1
        return hashes[starts], rank[starts] != rank[last]

    def entries(self, answers: dict[int, bytes], slots: int, width: int) -> Entries:
        """Stretches of the anchors that other documents have too."""
        hashes, shared = self.distinct()
        hot = np.zeros(len(hashes), bool)
        for slot, own in _by_slot(hashes, slots):
            size = own.stop - own.start
            bits = np.unpackbits(np.frombuffer(answers[slot], np.uint8), count=2 * size).astype(bool)
            shared[own] |= bits[:size]
            hot[own] = bits[size:]
        a = self.anchors
        at = np.searchsorted(hashes, a.hash)
        use = np.flatnonzero(shared[at] & ~hot[at])
        if hot.any():
            a = self._with_strings(np.flatnonzero(hot[at]), width)
            use = np.concatenate([use, np.arange(len(self.anchors.first), len(a.first))])
        # equal stretches of equal anchors are one entry, with the smallest rank
        longest = 2 * width
        padded = np.concatenate([self.data, np.zeros(longest, np.uint8)])
        size = a.count[use] + width - 1
        order, new = use, np.empty(0, bool)
        if len(use):
            text = np.lib.stride_tricks.as_strided(padded, (len(self.data), longest), (1, 1))
            sketch = np.zeros(len(use), np.uint64)  # tells stretches of one anchor apart
            for at in range(0, len(use), STEP // 4):
                some = slice(at, at + STEP // 4)
                rows = text[a.first[use[some]]] * (np.arange(longest) < size[some, None])
                words = np.ascontiguousarray(rows[:, : longest // 8 * 8]).view("<u8")
                for column in words.T:
                    sketch[some] = (sketch[some] ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    sketch[some] ^= sketch[some] >> np.uint64(29)
            rank = self.rank[a.doc[use]]
            sort = np.lexsort((rank, sketch, a.count[use], a.place[use], a.hash[use]))
            order = use[sort]
            keys = [a.hash[order], a.place[order], a.count[order], sketch[sort]]
            new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        return Entries(a, order, np.cumsum(new) - 1 if len(new) else new.astype(np.int64), order[new] if len(new) else order)

    def _with_strings(self, hot: np.ndarray, width: int) -> Anchors:
        """The anchors, and after them each string of the hot ones with the hash of the whole string."""
        a = self.anchors
        counts = a.count[hot]
        first = np.repeat(a.first[hot], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded, (len(self.data), 8), (1, 1))
        mixed = np.zeros(len(first), np.uint64)
        for at in [*range(0, width - 8, 8), width - 8]:
            for begin in range(0, len(first), STEP):
                some = slice(begin, begin + STEP)
                mixed[some] = (mixed[some] ^ words[first[some] + at].copy().view("<u8").ravel()) * np.uint64(0x9E3779B97F4A7C15)
                mixed[some] ^= mixed[some] >> np.uint64(29)
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
        one, none = np.ones(len(first), np.int64), np.zeros(len(first), np.int64)
        both = ((a.first, first), (a.count, one), (a.place, none), (a.hash, mixed), (a.doc, np.repeat(a.doc[hot], counts)))
        return Anchors(*(np.concatenate(x) for x in both))


@dataclass
class Entries:
    """Anchors that take part, sorted; the entry of each; and the anchor that stands for each entry."""

    anchors: Anchors
    anchor: np.ndarray
    entry: np.ndarray
    lead: np.ndarray


def _shared(hot_parts: int, table: pa.Table) -> pa.Table:
    """Per part of a slot: a bit for each of its hashes that another part sent too, then a bit for each hot one."""
    own = [_unpacked(raw.as_py()) for raw in table.column("hashes")]
    every, parts = np.unique(np.concatenate(own), return_counts=True)
    bits = []
    for hashes in own:
        count = parts[np.searchsorted(every, hashes)]
        bits.append(np.packbits(np.concatenate([count > 1, count > hot_parts])).tobytes())
    return pa.table({"part": table.column("part"), "slot": table.column("slot"), "answer": pa.array(bits, pa.binary())})


STRETCH = np.dtype([("hash", "<u8"), ("rank", "<i8"), ("place", "u1"), ("count", "u1")])


def _sorted_out(width: int, table: pa.Table) -> pa.Table:
    """Per part of a slot: for each of its entries, a mask of the strings that a smaller rank has too."""
    heads = [np.frombuffer(raw.as_py(), STRETCH) for raw in table.column("heads")]
    head = np.concatenate(heads)
    text = np.concatenate([np.frombuffer(raw.as_py(), np.uint8) for raw in table.column("texts")] + [np.zeros(2 * width, np.uint8)])
    size = head["count"].astype(np.int64) + width - 1
    begin = np.cumsum(size) - size
    longest = 2 * width
    view = np.lib.stride_tricks.as_strided(text, (len(text) - longest + 1, longest), (1, 1))
    everything = ((np.uint64(1) << head["count"].astype(np.uint64)) - np.uint64(1)).astype(np.uint64)
    mask = np.zeros(len(head), np.uint64)
    # anchors with one entry repeat nothing
    order = np.argsort(head["hash"], kind="stable")
    hashes = head["hash"][order]
    group = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]]))
    order = order[np.bincount(group)[group] > 1]
    if len(order):
        # entries that are equal as a whole are one, and all but the smallest rank lose everything
        rows = view[begin[order]] * (np.arange(longest) < size[order, None])
        words = np.ascontiguousarray(rows[:, : longest // 8 * 8]).view(">u8")
        keys = [head["rank"][order], *words.T[::-1], head["count"][order], head["place"][order], head["hash"][order]]
        sort = np.lexsort(keys)
        order, words = order[sort], words[sort]
        same = (words[1:] == words[:-1]).all(axis=1)
        for name in ("hash", "place", "count"):
            same &= head[name][order][1:] == head[name][order][:-1]
        new = np.concatenate([[True], ~same])
        number = np.cumsum(new) - 1
        lead = order[new]
        later = head["rank"][order] > head["rank"][lead[number]]
        mask[order[later]] = everything[order[later]]
        # suffixes of the entries of anchors that still have two or more
        hashes = head["hash"][lead]
        group = np.cumsum(np.concatenate([[0], hashes[1:] != hashes[:-1]]))
        wanted = np.flatnonzero(np.bincount(group)[group] > 1)
        found = np.zeros(len(lead), np.uint64)
        for some in _in_groups(group[wanted], head["count"][lead[wanted]]):
            part = wanted[some]
            counts = head["count"][lead[part]].astype(np.int64)
            entry = np.repeat(part, counts)
            nth = np.arange(len(entry)) - np.repeat(np.cumsum(counts) - counts, counts)
            # strings are equal only if the anchor has the same place in them
            key = group[entry].astype(np.int64) * 256 + head["place"][lead[entry]].astype(np.int64) - nth + 128
            rank = head["rank"][lead[entry]]
            for at, kind in deep_shallow(key, view[begin[lead[entry]] + nth][:, :width]):
                least = np.full(int(kind.max()) + 1, NO_ID)
                np.minimum.at(least, kind, rank[at])
                gone = at[rank[at] > least[kind]]
                np.bitwise_or.at(found, entry[gone], np.uint64(1) << nth[gone].astype(np.uint64))
        mask[order] |= found[number]
    cut = np.cumsum([len(h) for h in heads])[:-1]
    answers = [m.astype("<u8").tobytes() for m in np.split(mask, cut)]
    return pa.table({"part": table.column("part"), "slot": table.column("slot"), "answer": pa.array(answers, pa.binary())})


def _in_groups(group: np.ndarray, weight: np.ndarray, most: int = STRINGS) -> Iterator[slice]:
    """Slices of sorted groups, whole, with about ``most`` weight each."""
    if not len(group):
        return
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    total = np.cumsum(np.add.reduceat(weight.astype(np.int64), starts))
    turn = total // most
    cuts = np.append(starts[np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]]))], len(group))
    for begin, end in zip(cuts[:-1], cuts[1:]):
        yield slice(int(begin), int(end))


def cut_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    part_bytes: int = PART_BYTES,
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``spans`` (begin, end) of the removed bytes, and ``kept``, the other bytes.

    A byte goes if a ``width``-byte string covers it that also starts in a document with a smaller id; strings are
    those of the whole input. Ids are integers. Rows that share an id take nothing from each other; a row without id
    comes after all others and takes nothing from anyone. Null and empty texts have no bytes, texts under ``width``
    bytes lose none; an empty table gives an empty result; other columns are not read. ``kept`` is binary, since a cut
    can fall within a character.
    """
    if not GRAM + 8 <= width <= GRAM + 60:
        raise ValueError(f"width must be {GRAM + 8} to {GRAM + 60} bytes")
    spark = docs.sparkSession
    ship_package(spark)
    rows = pack(docs, id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    parts = bucketed(rows.mapInArrow(partial(_pack_parts, part_bytes), "part long, data binary, ids array<long>, ends array<long>, size long"), "part")
    total = parts.agg(F.sum("size")).first()[0] or 0
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLOT_BYTES + 1)

    def send_hashes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                hashes, _ = Part.of(row, width).distinct()
                cut = list(_by_slot(hashes, slots))
                arrays = [
                    pa.array([row["part"]] * len(cut), pa.int64()),
                    pa.array([slot for slot, _ in cut], pa.int64()),
                    pa.array([_packed(hashes[own]) for _, own in cut], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "slot", "hashes"])

    def shared(table: pa.Table) -> pa.Table:
        return _shared(hot_parts, table)

    def heard(table: pa.Table) -> dict[int, bytes]:
        return dict(zip(table.column("slot").to_pylist(), table.column("answer").to_pylist()))

    def send_stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        number, slot_of, heads, texts = [], [], [], []
        for row in left.to_pylist():
            part = Part.of(row, width)
            entries = part.entries(heard(right), slots, width)
            a, lead = entries.anchors, entries.lead
            head = np.zeros(len(lead), STRETCH)
            head["hash"], head["rank"] = a.hash[lead], part.rank[a.doc[lead]]
            head["place"], head["count"] = a.place[lead], a.count[lead]
            raw = row["data"]
            for slot, own in _by_slot(head["hash"], slots):
                number.append(row["part"])
                slot_of.append(slot)
                heads.append(head[own].tobytes())
                begin = a.first[lead[own]].tolist()
                end = (a.first[lead[own]] + a.count[lead[own]] + width - 1).tolist()
                texts.append(b"".join([raw[b:e] for b, e in zip(begin, end)]))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip((number, slot_of, heads, texts), kinds)], names=["part", "slot", "heads", "texts"])

    def sorted_out(table: pa.Table) -> pa.Table:
        return _sorted_out(width, table)

    def cut(key: tuple, left: pa.Table, right: pa.Table, more: pa.Table) -> pa.Table:
        out = {"id": [], "n_bytes": [], "spans": [], "kept": []}
        for row in left.to_pylist():
            part = Part.of(row, width)
            entries = part.entries(heard(right), slots, width)
            a = entries.anchors
            masks = np.zeros(len(entries.lead), np.uint64)
            answers = heard(more)
            for slot, own in _by_slot(a.hash[entries.lead], slots):
                masks[own] = np.frombuffer(answers[slot], "<u8")
            rank, lead = part.rank[a.doc[entries.anchor]], entries.lead
            mask = masks[entries.entry] if len(lead) else masks
            counts = a.count[entries.anchor]
            if len(lead):
                # all but the smallest rank of an entry lose all its strings
                later = rank > part.rank[a.doc[lead]][entries.entry]
                mask[later] = (np.uint64(1) << counts[later].astype(np.uint64)) - np.uint64(1)
            string = np.repeat(a.first[entries.anchor], counts)
            nth = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
            gone = np.sort((string + nth)[(np.repeat(mask, counts) >> nth.astype(np.uint64) & np.uint64(1)).astype(bool)])
            doc = np.searchsorted(part.ends, gone, side="right")
            new = np.concatenate([[True], (gone[1:] > gone[:-1] + width) | (doc[1:] != doc[:-1])]) if len(gone) else np.empty(0, bool)
            begin = gone[new]
            end = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1] + width if len(gone) else gone
            low = np.searchsorted(begin, np.concatenate([[0], part.ends[:-1]]))
            high = np.searchsorted(begin, part.ends)
            raw, start = row["data"], 0
            for i, stop in enumerate(part.ends.tolist()):
                spans = list(zip(begin[low[i] : high[i]].tolist(), end[low[i] : high[i]].tolist()))
                edges = [start, *(x for span in spans for x in span), stop]
                out["id"].append(part.ids[i])
                out["n_bytes"].append(stop - start)
                out["spans"].append([{"begin": b - start, "end": e - start} for b, e in spans])
                out["kept"].append(b"".join([raw[b:e] for b, e in zip(edges[::2], edges[1::2])]))
                start = stop
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), _RESULT)})

    slot_rows = parts.select("part", "data", "ids", "ends").mapInArrow(send_hashes, "part long, slot long, hashes binary")
    answer = "part long, slot long, answer binary"
    first = bucketed(slot_rows.groupBy("slot").applyInArrow(shared, answer), "part")
    sides = lambda x: parts.select("part", "data", "ids", "ends").groupBy("part").cogroup(x.groupBy("part"))
    stretches = sides(first).applyInArrow(send_stretches, "part long, slot long, heads binary, texts binary")
    second = stretches.groupBy("slot").applyInArrow(sorted_out, answer)
    both = first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2)))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        turn = np.array(right.column("turn").to_pylist())
        return cut(key, left, right.filter(pa.array(turn == 1)), right.filter(pa.array(turn == 2)))

    out = sides(both).applyInArrow(finish, "id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


_RESULT = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
