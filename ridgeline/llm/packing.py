"""Packing documents into sequences of bounded length by patterns with non-negative repeat counts.

Documents become pieces of at most ``limit`` tokens. Only the histogram of piece lengths, at most ``limit`` numbers
whatever the size of the corpus, is planned:

* patterns are the multisets of up to ``most`` length classes that fill a sequence exactly;
* non-negative least squares finds how often each pattern should be repeated so that the classes come out as often as
  they occur;
* the counts are rounded in a few ways (the best plan stands), and each pattern is dealt exact lengths: the last place takes the longest length that still
  fits;
* what the patterns leave over goes to the sequence with the least sufficient room, the longest first.

All of this handles equal sequences and equal lengths together, so the plan does not grow with the documents. Pieces of
one length are numbered by counts for each task, never by a sort in one place, and look up their sequence and place by
length and number.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, pack, ship_package, shipped_file

KNOWN_ENTRIES = 800_000  # words whose ids a Python worker remembers (some 200 MB); a full memory is emptied
KNOWN_LENGTH = 64  # longer ones are encoded anew each time
BATCH = 256  # documents that look up their unknown words together
# Plain characters are those that normalization leaves as they are or lowers one by one.
PLAIN_END = 0x180  # whose lower forms are plain too
BEYOND = re.compile(f"[^\\x00-{chr(PLAIN_END - 1)}]|\u0130")


def plain_words() -> re.Pattern:
    """The words of plain, lowered text: contractions, runs of letters, single numbers, runs of other characters."""
    kinds: dict[str, list[str]] = {"letter": [], "number": [], "space": []}
    for char in map(chr, range(PLAIN_END)):
        # the separators of information are white space to Python, but not to Unicode
        space = char.isspace() and not "\x1c" <= char <= "\x1f"
        kind = "space" if space else {"L": "letter", "N": "number"}.get(unicodedata.category(char)[0])
        if kind:
            kinds[kind].append(re.escape(char))
    letter, number, space = ("".join(kinds[k]) for k in ("letter", "number", "space"))
    # The contractions that the vocabulary's own splitter knows.
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


class WordEncoder:
    """Ids of texts by the tokenizers library, which encodes each word between white space once.

    White space ends a word of these vocabularies and is then dropped, and case is folded, so the ids of a text are
    those of its lowered words, one after another. Runs of other than plain characters, and runs with special strings,
    are encoded whole.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.words = plain_words()
        self.spaces = regex.compile(r"\s+")

    def _odd(self, text: str) -> bool:
        return (not text.isascii() and BEYOND.search(text) is not None) or any(s in text for s in self.special)

    def units(self, text: str) -> list[str]:
        """Lowered plain words, and odd runs as they are."""
        if not self._odd(text):
            return self.words.findall(text.lower())
        out: list[str] = []
        for run in self.spaces.split(text):
            if self._odd(run):
                out.append(run)
            else:
                out += self.words.findall(run.lower())
        return out

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that are not remembered; short ones are remembered from now on."""
        odd = {u for u in units if self._odd(u)}
        out = {u: np.array(self.library.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in odd}
        words = list(units - odd)
        if words:  # one call for many; the library says which id belongs to which word
            encoded = self.library.encode(" ".join(words), add_special_tokens=False)
            data, of = np.array(encoded.ids, "<u4").tobytes(), np.array(encoded.word_ids)
            edges = [0, *(4 * (np.flatnonzero(np.diff(of)) + 1)).tolist(), len(data)]
            if len(edges) != len(words) + 1:
                raise ValueError("the vocabulary does not keep words apart")
            out.update(zip(words, (data[a:b] for a, b in zip(edges, edges[1:]))))
        if len(self.known) + len(out) > KNOWN_ENTRIES:
            self.known.clear()
        self.known.update((u, ids) for u, ids in out.items() if len(u) <= KNOWN_LENGTH)
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        units = [self.units(text) for text in texts]
        found = [list(map(self.known.get, own)) for own in units]
        gaps = [list(_places(got, None)) for got in found]
        unknown = {own[i] for own, places in zip(units, gaps) for i in places}
        learnt = self.learn(unknown) if unknown else {}
        for own, got, places in zip(units, found, gaps):
            for i in places:
                got[i] = learnt[own[i]]
            yield b"".join(got)


def _places(values: list, wanted: object) -> Iterator[int]:
    """Where a value stands in a list, without a look at each entry in Python."""
    at = -1
    for _ in range(values.count(wanted)):
        at = values.index(wanted, at + 1)
        yield at


PIECES = "piece int, start long, length long, ids_crc32 long, part int, place long"


def _pieces(file: shipped_file, limit: int, closing: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, end = file.build(WordEncoder), np.array([closing], "<u4").tobytes()
    part, places = TaskContext.get().partitionId(), Counter()
    names = [f.split()[0] for f in PIECES.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            some = batch.slice(at, BATCH)
            owner, rows = [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in some.column(1).to_pylist()])):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * limit)):
                    cut = ids[start : start + 4 * limit]
                    length = len(cut) // 4
                    owner.append(i)
                    rows.append((piece, start // 4, length, zlib.crc32(cut), part, places[length]))
                    places[length] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner, pa.int32())), *columns], ["id", *names])


def token_pieces(docs: DataFrame, vocabulary: str, limit: int = 4096, closing: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, part, place`` of each piece of each text; a narrow pass, stored once.

    ``place`` numbers the pieces of one length within the ``part`` (task) that made them.
    """
    rows = pack(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    ship_package(docs.sparkSession)
    work = partial(_pieces, shipped_file(docs.sparkSession, vocabulary), limit, closing)
    return materialize(rows.mapInArrow(work, f"id {kind}, {PIECES}"), "pieces")


def class_patterns(units: int, most: int) -> np.ndarray:
    """Every multiset of up to ``most`` classes 1..units that adds up to ``units``: a row of counts for each."""
    found: list[list[int]] = []

    def grow(chosen: list[int], left: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < most:
            for size in range(min(left, chosen[-1] if chosen else units), 0, -1):
                if size * (most - len(chosen)) < left:
                    break  # even equal ones cannot fill the rest
                grow([*chosen, size], left - size)

    grow([], units)
    out = np.zeros((len(found), units + 1))
    for row, chosen in zip(out, found):
        np.add.at(row, chosen, 1)
    return out


def nonnegative_fit(columns: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimizes ``|columns @ x - wanted|``, by active sets."""
    rows, width = columns.shape
    x, free = np.zeros(width), np.zeros(width, bool)
    least = 1e-9 * max(1.0, float(np.abs(columns.T @ wanted).max(initial=0.0)))
    for _ in range(20 * rows):
        slope = np.where(free, -np.inf, columns.T @ (wanted - columns @ x))
        if not width or slope.max() <= least:
            break
        free[int(slope.argmax())] = True
        while free.any():
            chosen = np.flatnonzero(free)
            best = np.linalg.lstsq(columns[:, chosen], wanted, rcond=None)[0]
            if best.min() > 0:
                x[:] = 0.0
                x[chosen] = best
                break
            # go towards the best point until a count becomes zero; that pattern leaves
            now, low = x[chosen], best <= 0
            step = (now[low] / np.maximum(now[low] - best[low], 1e-300)).min()
            x[chosen] = np.where(low & (now + step * (best - now) <= 1e-12 * now.max(initial=1.0)), 0.0, now + step * (best - now))
            free[chosen[x[chosen] <= 0.0]] = False
    return x


@dataclass
class Group:
    """Equal sequences: how many, what each holds as ``(length, how often)``, and the room that is left."""

    size: int
    runs: tuple[tuple[int, int], ...]
    room: int


def classes_of(left: dict[int, int], limit: int, units: int) -> list[list[int]]:
    """The lengths of each class, the longest first."""
    width = -(-limit // units)
    classes: list[list[int]] = [[] for _ in range(units + 1)]
    for length in sorted(left, reverse=True):
        classes[-(-length // width)].append(length)
    return classes


def fit_patterns(left: dict[int, int], limit: int, units: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of classes that occur, and how often each should be repeated."""
    classes = classes_of(left, limit, units)
    count_of = np.array([sum(left[n] for n in own) for own in classes], float)
    patterns = class_patterns(units, most)
    patterns = patterns[((patterns == 0) | (count_of > 0)).all(axis=1)]
    weight = np.arange(units + 1) / units  # a long piece left over costs more than a short one
    return patterns, nonnegative_fit((patterns * weight).T, count_of * weight)


def deal_patterns(left: dict[int, int], limit: int, units: int, patterns: np.ndarray, repeats: np.ndarray) -> Iterator[Group]:
    """Sequences after the patterns; takes what they hold out of ``left``, the number of pieces by length."""
    classes, width = classes_of(left, limit, units), -(-limit // units)

    def longest(own: list[int]) -> int | None:
        while own and not left[own[0]]:
            own.pop(0)
        return own[0] if own else None

    lengths = sorted(left)
    for k in np.argsort(-repeats, kind="stable"):
        parts = [c for c in range(units, 0, -1) for _ in range(int(patterns[k][c]))]
        wanted = int(repeats[k])
        while wanted > 0:
            # a step uses up a length or ends the pattern, so there are no more steps than lengths and patterns
            held = [longest(classes[c]) for c in parts[:-1]]
            if None in held:
                break
            use = Counter(held)
            size = min(wanted, *(left[n] // times for n, times in use.items())) if use else wanted
            if size == 0:  # one length for two places, but a single piece of it
                least = min(use, key=left.get)
                classes[-(-least // width)].remove(least)
                continue
            room = limit - sum(held)
            last = _below(lengths, left, room, use, (parts[-1] - 1) * width + 1)
            if last is not None:
                use[last] += 1
                size = min(size, left[last] // use[last])
                room -= last
            elif not held:
                break
            for length, times in use.items():
                left[length] -= size * times
            wanted -= size
            yield Group(size, tuple(sorted(use.items(), reverse=True)), room)


def _below(lengths: list[int], left: dict[int, int], room: int, use: Counter, least: int) -> int | None:
    """The longest length of ``least`` or more that fits the room and of which a piece is left besides those in use."""
    at = bisect_left(lengths, room + 1) - 1
    while at >= 0 and lengths[at] >= least:
        if left[lengths[at]] > use[lengths[at]]:
            return lengths[at]
        at -= 1
    return None


def best_fit(left: dict[int, int], groups: list[Group], limit: int) -> list[Group]:
    """All pieces in ``left`` added to the sequences with the least sufficient room, the longest pieces first."""
    done: list[Group] = []
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(group: Group) -> None:
        if group.room not in by_room:
            by_room[group.room] = []
            insort(rooms, group.room)
        by_room[group.room].append(group)

    for group in groups:
        put(group)
    for length in sorted((n for n in left if left[n]), reverse=True):
        pieces = left[length]
        while pieces:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                group = Group(pieces, (), limit)  # new sequences, as many as could be needed
            else:
                group = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    del by_room[rooms.pop(at)]
            each = group.room // length
            whole = min(group.size, pieces // each)
            if whole:
                put(Group(whole, (*group.runs, (length, each)), group.room - length * each))
                pieces -= whole * each
            rest = group.size - whole
            if rest and pieces:
                some = min(each, pieces)
                put(Group(1, (*group.runs, (length, some)), group.room - length * some))
                pieces -= some
                rest -= 1
            if rest and group.runs:
                put(Group(rest, group.runs, group.room))
        left[length] = 0
    for own in by_room.values():
        done.extend(own)
    return done


@dataclass
class Plan:
    """For pieces of one length numbered from ``first``: ``each`` of them go to every sequence from ``sequence`` on."""

    key: np.ndarray  # length and number of the first piece, in one sorted integer
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


# Counts are rounded to the nearest, and down from these shares of them: the fewest sequences win.
KEPT_SHARES = (1.0, 0.95, 0.9, 0.8, 0.65, 0.5)
SHIFT = 44  # bits for the number of a piece among those of its length


def pack_lengths(histogram: dict[int, int], limit: int, units: int = 64, most: int = 3) -> Plan:
    """Where pieces go, by length and number; see the module's text."""
    units = min(units, limit)
    counts = {int(n): int(times) for n, times in histogram.items() if times}
    patterns, repeats = fit_patterns(counts, limit, units, most)
    groups: list[Group] | None = None
    for rounded in (np.rint(repeats), *(np.floor(repeats * share) for share in KEPT_SHARES)):
        left = dict(counts)
        dealt = list(deal_patterns(left, limit, units, patterns, rounded.astype(np.int64)))
        found = best_fit(left, dealt, limit)
        if groups is None or sum(g.size for g in found) < sum(g.size for g in groups):
            groups = found
    used: Counter = Counter()
    rows, sequence = [], 0
    for group in groups:
        offset = 0
        for length, each in group.runs:
            rows.append(((length << SHIFT) + used[length], used[length], each, sequence, offset))
            used[length] += group.size * each
            offset += length * each
        sequence += group.size
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def _place(plan, batch: pa.RecordBatch) -> pa.RecordBatch:
    plan = plan.value
    length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
    row = np.searchsorted(plan.key, (length << SHIFT) + number, side="right") - 1
    among = number - plan.first[row]
    sequence = plan.sequence[row] + among // plan.each[row]
    offset = plan.offset[row] + among % plan.each[row] * length
    kept = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
    return pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 4096,
    closing: int = 1,
    units: int = 64,
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all texts with their places: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    A text is encoded without special tokens of its own and closed with the id ``closing``; texts of more than
    ``limit`` tokens are cut. A null text counts as empty and is one token long. Null and repeated ids are kept, a
    document for each row; texts of any length are cut piece by piece; equal lengths share patterns; an empty table
    gives an empty result; other columns are not read. ``vocabulary`` is a path on the driver.

    The plan holds one row for each length in each group of equal sequences. Every step that makes a group uses up a
    length or ends a pattern, so there are less than ``4 * limit`` groups, of less than ``sqrt(2 * limit)`` lengths
    each; this bounds the broadcast (60 MB for 4,096 tokens, some 100 KB in practice) at any number of documents.
    """
    # first numbers grow with tasks, so they are joined by a sort on both sides, never sent to every task
    spark = docs.sparkSession
    pieces = token_pieces(docs, vocabulary, limit, closing, id_col, text_col)
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("pieces")), "piece-counts")
    histogram = {r["length"]: r["pieces"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}
    plan = spark.sparkContext.broadcast(pack_lengths(histogram, limit, units, most))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("first"))
    placed = pieces.join(first.hint("merge"), (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    numbered = placed.select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("number"))
    kind = pieces.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _place(plan, batch)

    out = numbered.mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
