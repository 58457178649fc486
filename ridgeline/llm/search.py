"""Exact top-k search by BM25 over an inverted index with block-max pruning.

Documents are packed into shards, each with its own inverted index: postings by term, and for every block of 64
documents the largest contribution of the term. Document frequencies and lengths are those of all shards, so scores of
different shards can be merged. A query sums up the block maxima of its terms. Blocks are scored in the order of that
bound, and the search in a shard stops when no bound reaches the score of the k-th best document so far: what is left
out cannot be among the k best, so the result is exact.

Documents and queries are dealt by topic, above all by language, told by their most frequent terms. A shard holds
documents of a topic, and a block queries of a topic and of about the same number of terms, so most terms are frequent on
both sides or on none. Every query meets every document: shards of its topic in pieces of documents of about one size,
others as a whole.

Shards of a topic are searched in waves, each with three times the shards before it. From the second wave on a query
brings the score of its k-th best document so far, which its k-th best of all documents has at least, and a shard returns
only documents that reach it, so the rows between the waves and the merge follow the queries. There all documents of a
shard are scored at first in single precision, and exactly where that can be enough.

A contribution, ``idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length))``, is rounded to a whole number
of millionths. Sums of whole numbers do not depend on their order, so ties are exact; they go to the smaller id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_map, materialize, pack
from ridgeline.session import scratch_path, ship_package

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # after A-Z are in lower case
SHARD_BYTES = 32 << 20
SHARD_DOCS = 60_000
BLOCK_DOCS = 64
BLOCK_TERMS = 1 << 19  # query terms in a block of queries
TASK_TERMS = 1 << 22  # and in the blocks of a task
WAVE = 4  # a wave ends at so many times the shards searched before
POSTINGS = 1 << 18  # postings weighed at once
CELLS = 1 << 22  # cells of a matrix of scores or contributions (32 MB)
SPARSE = 64  # whole lists: a term is added by products if its share of queries times its share of documents reaches one in so many
TABLE = 1 << 23  # cells of the table of a shard's most frequent terms (32 MB)
DENSE = 64  # those are in one of so many documents
PRODUCT = 240  # a product of matrices adds so many cells in the time of a posting of a list
LISTED = 1 << 15  # postings of lists added at once
TOPICS = 8  # kinds of texts at most, by their most frequent terms
TOPIC_TERMS = 512  # so many terms tell them apart
SAMPLE = 1024  # queries that topics are taken from, about
ALIKE = 0.5  # topics whose terms have this cosine are one
PIECE_DOCS = 3500  # documents of a shard, in the order of their sizes, that queries of their topic search together
SHARD_POSTINGS = 3 << 20  # of parts that make a shard
BATCH_BYTES = 16 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
UNIT = 1e6
NO_ID = np.iinfo(np.int64).max


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of a whole text, and how often each is there."""
    counts = Counter(TERM.findall((text or "").encode().lower()))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, counts)), ">u8").astype(np.uint64)
    return hashes, np.fromiter(counts.values(), np.int64, len(counts))


class Topics:
    """Kinds of texts by the most frequent terms of some of them, languages above all.

    Texts of a topic share many terms, those of different topics few, so both are cheap to score when kept apart. Topics
    decide where documents and queries are held, never which of them meet.
    """

    def __init__(self, sample: list[np.ndarray]):
        every, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sample]), return_counts=True)
        self.terms = np.sort(every[np.lexsort((every, -counts))[:TOPIC_TERMS]])
        self.weights = np.zeros((1, len(self.terms)), np.float32)
        rows = np.zeros((len(sample), len(self.terms)), np.float32)
        for row, hashes in zip(rows, sample):
            row[self._places(hashes)] = 1
        rows = rows[rows.sum(1) >= 8]  # others hardly tell
        if not len(rows):
            return
        rows = self._unit(rows[np.lexsort(rows.T)])
        seeds = [int(np.argmax(rows @ rows.mean(0)))]
        while len(seeds) < min(TOPICS, len(rows)):
            seeds.append(int(np.argmin((rows @ rows[seeds].T).max(1))))
        found = rows[seeds]
        for _ in range(8):
            near = np.argmax(rows @ found.T, 1)
            sizes = np.bincount(near, minlength=len(found))
            found = self._unit(np.stack([rows[near == i].sum(0) for i in np.flatnonzero(sizes * 50 >= len(rows))]))
        sums = [rows[np.argmax(rows @ found.T, 1) == i].sum(0) for i in range(len(found))]
        while len(sums) > 1:
            unit = self._unit(np.stack(sums))
            cosine = unit @ unit.T - 2 * np.eye(len(sums))
            i, j = divmod(int(np.argmax(cosine)), len(sums))
            if cosine[i, j] < ALIKE:
                break
            sums[min(i, j)] = sums[i] + sums[j]
            del sums[max(i, j)]
        self.weights = self._unit(np.stack(sums))

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at[self.terms[at] == hashes]

    def of(self, hashes: np.ndarray) -> int:
        """The topic of a text of some distinct terms."""
        return int(np.argmax(self.weights[:, self._places(hashes)].sum(1))) if len(self.weights) > 1 else 0


def _shard(shard: int, ids: list[int | None], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Inverted index of some documents, in the order of their ids."""
    rank = np.array([NO_ID if i is None else i for i in ids], np.int64)
    order = np.argsort(rank, kind="stable")
    sizes = np.array([len(found[i][0]) for i in order])
    hashes = np.concatenate([found[i][0] for i in order])
    times = np.concatenate([found[i][1] for i in order])
    doc = np.repeat(np.arange(len(ids)), sizes)
    sort = np.argsort(hashes, kind="stable")
    hashes, doc, times = hashes[sort], doc[sort], times[sort]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    length = np.array([int(found[i][1].sum()) for i in order], np.int64)
    put = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    arrays = [
        pa.array([shard], pa.int64()),
        put(rank[order], "<i8"),
        put(length, "<i8"),
        put(hashes[starts], "<u8"),
        put(np.append(starts, len(hashes)), "<i8"),
        put(doc, "<u2"),
        put(np.minimum(times, MANY), "u1"),
        put(np.stack([np.flatnonzero(times >= MANY), times[times >= MANY]], 1), "<i8"),
        pa.array([len(ids)], pa.int64()),
        pa.array([int(length.sum())], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(arrays, SHARD_NAMES)


SHARD_NAMES = ["shard", "ids", "lengths", "terms", "starts", "docs", "times", "often", "n_docs", "n_words"]
SHARD_SCHEMA = (
    "shard long, ids binary, lengths binary, terms binary, starts binary, docs binary, times binary, often binary, "
    "n_docs long, n_words long"
)
READY = {"ids": "<i8", "terms": "<u8", "starts": "<i8", "docs": "<u2", "impacts": "<i4"}  # a shard with contributions
MANY = 255  # a term that is in a document so often has its place and number in ``often``


INDEX_SCHEMA = SHARD_SCHEMA + ", topic int"


def _index(source: Iterator[pa.RecordBatch], topics: Topics) -> Iterator[pa.RecordBatch]:
    """Documents of a task, packed by topic into parts of shards in the order they come."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    open_parts: dict[int, tuple[list[int | None], list[tuple[np.ndarray, np.ndarray]]]] = {}
    sizes: Counter[int] = Counter()

    def closed(topic: int) -> pa.RecordBatch:
        nonlocal number
        part = _shard(number, *open_parts.pop(topic))
        number, sizes[topic] = number + 1, 0
        return part.append_column("topic", pa.array([topic], pa.int32()))

    for batch in source:
        for doc, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            counts = term_counts(text)
            topic = topics.of(counts[0])
            if topic in open_parts and (sizes[topic] + len(text) > SHARD_BYTES or len(open_parts[topic][0]) >= SHARD_DOCS):
                yield closed(topic)
            elif sizes.total() + len(text) > SHARD_BYTES and open_parts:
                yield closed(max(open_parts, key=sizes.__getitem__))
            ids, found = open_parts.setdefault(topic, ([], []))
            ids.append(doc.as_py())
            found.append(counts)
            sizes[topic] += len(text)
    for topic in sorted(open_parts):
        yield closed(topic)


def _frequencies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (term, documents) of shards: each term once for a shard."""
    terms = np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in batch.column(1)])
    counts = np.concatenate([np.diff(np.frombuffer(x.as_py(), "<i8")) for x in batch.column(2)])
    shard = np.repeat(np.array(batch.column(0)), [len(x.as_py()) // 8 for x in batch.column(1)])
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(terms.view(np.int64)), pa.array(counts)], ["shard", "term", "docs"])


def _query_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    packed = [np.sort(term_counts(value.as_py())[0]).astype("<u8").tobytes() for value in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 8 for p in packed], pa.int64())], ["query", "terms", "size"])


def _query_topics(topics: Topics, batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [topics.of(np.frombuffer(x.as_buffer(), "<u8")) for x in batch.column(1)]
    return batch.append_column("topic", pa.array(found, pa.int32()))


def _blocks(weights: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """For kinds of queries, each a topic and a class of sizes, the first of their blocks and how many they have.

    Neighbouring classes of a topic share blocks if they are small.
    """
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    for topic in sorted({t for t, _ in weights}):
        first = len(runs)
        open_run: list[tuple[int, int]] = []
        for kind in sorted(k for k in weights if k[0] == topic):
            open_run.append(kind)
            weight = sum(weights[k] for k in open_run)
            if weight * 2 >= BLOCK_TERMS:
                runs.append((weight, open_run))
                open_run = []
        if open_run:
            weight = sum(weights[k] for k in open_run)
            if len(runs) > first and weight * 8 < BLOCK_TERMS:
                weight, open_run = weight + runs[-1][0], runs.pop()[1] + open_run
            runs.append((weight, open_run))
    out, block = {}, 0
    for weight, kinds in runs:
        blocks = -(-weight // BLOCK_TERMS)
        out |= dict.fromkeys(kinds, (block, blocks))
        block += blocks
    return out


def _query_block(table: pa.Table) -> pa.Table:
    """A block of queries: its distinct terms, and for each query, smaller ones first, the places of its terms there."""
    size = np.array([len(x.as_buffer()) // 8 for x in table.column("terms")], np.int64)
    order = np.argsort(size, kind="stable")
    terms = [np.frombuffer(table.column("terms")[i].as_buffer(), "<u8") for i in order.tolist()]
    wanted, asked = np.unique(np.concatenate(terms), return_inverse=True)
    columns = (table.column("query").to_numpy()[order], wanted, asked, size[order], table.column("least").to_numpy()[order])
    packed = {n: pa.array([x.astype(kind).tobytes()], pa.binary()) for (n, kind), x in zip(BLOCK_KINDS.items(), columns)}
    return pa.table({"block": table.column("block")[:1], **packed, "topic": table.column("topic")[:1]})


# numbers of queries, their distinct terms, the place there of each term of each query, sizes of queries, the scores to reach
BLOCK_KINDS = {"numbers": "<i8", "wanted": "<u8", "asked": "<i4", "sizes": "<i8", "least": "<f8"}
BLOCK_SCHEMA = "block long, " + ", ".join(f"{n} binary" for n in BLOCK_KINDS) + ", topic int"


class Shard:
    """An index with the contribution of each posting, ready to be searched."""

    def __init__(self, row: dict, weights: np.ndarray, mean: float, k1: float, b: float):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self._read(row)
        times = read("times", "u1")
        often = read("often", "<i8").reshape(-1, 2)
        norm = k1 * (1 - b + b * read("lengths", "<i8") / (mean or 1.0))
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))
        self.impacts = np.empty(len(term), np.int32)
        for at in range(0, len(term), POSTINGS):
            some = slice(at, at + POSTINGS)
            tf = times[some].astype(np.float64)
            here = often[(often[:, 0] >= at) & (often[:, 0] < at + POSTINGS)]
            tf[here[:, 0] - at] = here[:, 1]
            self.impacts[some] = np.rint(weights[term[some]] * (tf * (k1 + 1) / (tf + norm[self.docs[some]])) * UNIT)

    @classmethod
    def stored(cls, row: dict) -> Shard:
        """From a row that has the contributions."""
        shard = cls.__new__(cls)
        shard._read(row)
        shard.impacts = np.frombuffer(row["impacts"], "<i4")
        return shard

    def _read(self, row: dict) -> None:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.terms, self.starts, self.docs = read("ids", "<i8"), read("terms", "<u8"), read("starts", "<i8"), read("docs", "<u2")
        self.size = len(self.ids)
        self.blocks = -(-self.size // BLOCK_DOCS)

    @classmethod
    def pieces(cls, parts: list[Shard]) -> Iterator[Shard]:
        """Documents of parts of a shard together, then those of about the same number of terms by themselves.

        The list of parts is emptied on the way.
        """
        ids = np.concatenate([p.ids for p in parts])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        place = np.empty(len(ids), np.uint16)
        place[order] = np.arange(len(ids))
        terms, key = np.unique(np.concatenate([p.terms for p in parts]), return_inverse=True)
        key = np.repeat(key << 16, np.concatenate([np.diff(p.starts) for p in parts]))
        at = 0
        for first, part in zip(np.cumsum([0, *(p.size for p in parts)]).tolist(), parts):
            key[at : at + len(part.docs)] |= place[first : first + part.size][part.docs]
            at += len(part.docs)
        impacts = np.concatenate([p.impacts for p in parts])
        parts.clear()
        order = np.argsort(key)
        impacts, key = impacts[order], key[order]
        del order
        docs, term = key.astype(np.uint16), (key >> 16).astype(np.int32)
        del key
        sizes = np.bincount(docs, minlength=len(ids))
        whole = cls._piece(ids, terms, term, docs, impacts)
        yield whole
        for own in np.array_split(np.argsort(sizes, kind="stable"), max(1, round(len(ids) / PIECE_DOCS))):
            here = np.zeros(len(ids), bool)
            here[own] = True
            kept = here[docs]
            yield cls._piece(ids[here], terms, term[kept], (np.cumsum(here) - 1).astype(np.uint16)[docs[kept]], impacts[kept])

    @classmethod
    def _piece(cls, ids: np.ndarray, terms: np.ndarray, term: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> Shard:
        """From postings in the order of terms and documents."""
        counts = np.bincount(term, minlength=len(terms))
        piece = cls.__new__(cls)
        piece.ids, piece.docs, piece.impacts = ids, docs, impacts
        piece.terms, piece.starts = terms[counts > 0], np.append(0, np.cumsum(counts[counts > 0]))
        return piece

    def batch(self, **columns: pa.Array) -> pa.RecordBatch:
        """One row of some columns and the index, without copies."""
        for name, kind in READY.items():
            value = np.ascontiguousarray(getattr(self, name), kind)
            ends = pa.py_buffer(np.array([0, value.nbytes], np.int32))
            columns[name] = pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(value)])
        return pa.RecordBatch.from_pydict(columns)

    @cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For terms in blocks: where their postings begin, the block, the largest contribution; and where each term's begin."""
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))
        block = self.docs // np.uint16(BLOCK_DOCS)
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.empty(0, np.int64)
        most = np.maximum.reduceat(self.impacts, new) if len(new) else np.empty(0, np.int32)
        return np.append(new, len(term)), block[new].astype(np.int64), most, np.searchsorted(new, self.starts)

    @cached_property
    def most(self) -> np.ndarray:
        """The largest contribution of each term."""
        return np.maximum.reduceat(self.impacts, self.starts[:-1]).astype(np.float64) if len(self.terms) else np.empty(0)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each term its row in a table, or -1; and the table: contributions of the most frequent terms by document."""
        counts = np.diff(self.starts)
        often = np.flatnonzero(counts * DENSE >= self.size)
        often = np.sort(often[np.argsort(-counts[often], kind="stable")][: TABLE // max(1, self.size)])
        row = np.full(len(self.terms), -1)
        row[often] = np.arange(len(often))
        cells = np.zeros((len(often), self.size), np.float32)
        for own, begin, end in zip(cells, self.starts[often].tolist(), self.starts[often + 1].tolist()):
            own[self.docs[begin:end]] = self.impacts[begin:end]
        return row, cells

    @cached_property
    def padded(self) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each term a class of lengths and its row there; and for each class matrices of documents and contributions.

        A list is filled up to the length of its class by contributions of zero, so that many lists are taken at once.
        """
        counts = np.diff(self.starts)
        lengths = [1]
        while lengths[-1] < counts.max(initial=1):
            lengths.append(max(lengths[-1] + 1, lengths[-1] * 5 // 4))
        kind = np.searchsorted(lengths, counts).astype(np.uint8)
        row, classes = np.empty(len(counts), np.int64), []
        docs, values = self.docs.astype(np.int32), self.impacts.astype(np.float32)
        order = np.argsort(kind, kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=len(lengths))).tolist()
        for length, begin, end in zip(lengths, [0, *ends], ends):
            own = order[begin:end]
            row[own] = np.arange(len(own))
            at = np.minimum(self.starts[own][:, None] + np.arange(length), len(docs) - 1)
            filled = values[at]
            filled[np.arange(length) >= counts[own][:, None]] = 0
            classes.append((docs[at], filled))
        return kind, row, classes

    @cached_property
    def by_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the terms of each document begin, those, and their contributions."""
        order = np.argsort(self.docs, kind="stable")
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))
        return np.append(0, np.cumsum(np.bincount(self.docs, minlength=self.size))), term[order], self.impacts[order].astype(np.float64)

    @cached_property
    def heaviest(self) -> float:
        """The largest sum of a document's contributions: no score is above it."""
        return np.bincount(self.docs, weights=self.impacts, minlength=self.size).max(initial=0)

    def _add_lists(self, scores: np.ndarray, base: np.ndarray, places: np.ndarray) -> None:
        """Adds the lists of some terms to flat scores, each from its base on."""
        kind, row, classes = self.padded
        kinds = kind[places]
        order = np.argsort(kinds, kind="stable")
        rows, base = row[places[order]], base[order]
        ends = np.cumsum(np.bincount(kinds, minlength=len(classes))).tolist()
        for (docs, values), begin, end in zip(classes, [0, *ends], ends):
            step = max(1, LISTED // docs.shape[1])
            for low in range(begin, end, step):
                some = slice(low, min(low + step, end))
                at = docs.take(rows[some], axis=0) + base[some, None]
                np.add.at(scores, at.ravel(), values.take(rows[some], axis=0).ravel())

    def reaching(self, ats: list[np.ndarray], k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For queries the k best of the documents whose score is at least the query's ``least``, which is above zero.

        Gives the query's number, documents and scores. Scores of all documents are added up in single precision first,
        with room for all that rounding can lose: by a product of matrices for terms that are frequent in these queries
        and documents, by lists for the others. What is left then is added up exactly.
        """
        place = np.concatenate([np.empty(0, np.int64), *ats])
        query = np.repeat(np.arange(len(ats)), [len(at) for at in ats])
        able = (np.bincount(query, weights=self.most[place], minlength=len(ats)) >= least) & (least <= self.heaviest)
        numbers = np.flatnonzero(able)
        if not len(numbers):
            return
        if len(numbers) < len(ats):
            kept = able[query]
            place, query = place[kept], (np.cumsum(able) - 1)[query[kept]]
        sizes = np.bincount(query, minlength=len(numbers))
        starts = np.append(0, np.cumsum(sizes)).tolist()
        row, cells = self.table
        asked = np.bincount(place, minlength=len(self.terms))
        often = np.flatnonzero((row >= 0) & (asked * np.diff(self.starts) * PRODUCT >= len(numbers) * self.size))
        cells = cells[row[often]]
        column = np.full(len(self.terms), -1)
        column[often] = np.arange(len(often))
        # a sum of n numbers that are not negative loses less than n parts in 2**24, and each number one part
        room = 1 - (sizes.max() + 16) * 2.0**-23
        enough = (least[numbers] * room).astype(np.float32)[:, None]
        mark = np.zeros(len(self.terms))
        step = max(1, 2 * CELLS // max(1, self.size))  # as many bytes in single precision
        for begin in range(0, len(numbers), step):
            end = min(begin + step, len(numbers))
            own = slice(starts[begin], starts[end])
            there, places = query[own] - begin, place[own]
            columns = column[places]
            dense = columns >= 0
            member = np.zeros((end - begin, len(often)), np.float32)
            member[there[dense], columns[dense]] = 1
            scores = member @ cells
            self._add_lists(scores.reshape(-1), there[~dense] * self.size, places[~dense])
            which, docs = np.divmod(np.flatnonzero(scores >= enough[begin:end]), self.size)
            found, first = np.unique(which, return_index=True)
            for i, low, high in zip((found + begin).tolist(), first.tolist(), [*first[1:].tolist(), len(docs)]):
                asks = place[starts[i] : starts[i + 1]]
                mark[asks] = 1
                exact = self._exact(mark, docs[low:high])
                mark[asks] = 0
                kept = np.flatnonzero(exact >= least[numbers[i]])
                best = kept[np.lexsort((kept, -exact[kept]))][:k]  # documents are in the order of ids
                if len(best):
                    yield int(numbers[i]), docs[low + best], exact[best]

    def _exact(self, mark: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of some documents for terms that are marked by one, others by zero."""
        begins, terms, impacts = self.by_document
        return np.array([mark[terms[b:e]] @ impacts[b:e] for b, e in zip(begins[docs].tolist(), begins[docs + 1].tolist())])

    def lists(self, wanted: np.ndarray, asked: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """For each query of a block the places of its terms in the index."""
        if not len(self.terms):
            return [np.empty(0, np.int64)] * len(sizes)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        known = (self.terms[at] == wanted)[asked]
        ends = np.append(0, np.cumsum(known))[np.cumsum(sizes)]
        return np.split(at[asked[known]], ends[:-1])

    def _cut(self, values: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([x[b:e] for b, e in zip(begin.tolist(), end.tolist())]) for x in values]

    def search(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents for terms at some places of the index: documents, scores, and blocks scored."""
        return self.search_all([at], k)[0]

    def search_all(self, ats: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """``search`` for several queries; those whose bounds leave out too few blocks are scored together."""
        found = [self._bounded(at, k) for at in ats]
        late = [i for i, one in enumerate(found) if one is None]
        for i, scores in zip(late, self._whole([ats[i] for i in late])):
            found[i] = self._best(scores, k, self.blocks)
        return found

    def _best(self, scores: np.ndarray, k: int, done: int) -> tuple[np.ndarray, np.ndarray, int]:
        least = np.partition(scores, self.size - k)[self.size - k] if self.size >= k else 0.0
        place = np.flatnonzero(scores >= max(least, 1.0))
        place = place[np.lexsort((place, -scores[place]))][:k]  # places are in the order of ids
        return place, scores[place], done

    def _bounded(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """The best documents by blocks in the order of their bounds; None if half of the blocks or more are left in."""
        if not len(at):
            return np.empty(0, np.int64), np.empty(0), 0
        block_begin, block_of, block_most, block_starts = self.bounds
        first, last = block_starts[at], block_starts[at + 1]
        counts = last - first
        entry = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        bound = np.bincount(block_of[entry], weights=block_most[entry], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        scores = np.zeros(self.size)
        least, done, take = 0.0, 0, 2
        while done < len(order):
            now = order[done : done + take]
            now = now[bound[now] >= least]  # an equal bound may still win by the smaller id
            if not len(now):
                break
            # nearly all of the lists, by the score that the k-th best document has so far
            if done and 2 * np.count_nonzero(bound >= least) >= self.blocks or len(now) * 2 >= self.blocks:
                return None
            done += len(now)
            chosen = np.zeros(self.blocks, bool)
            chosen[now] = True
            own = entry[chosen[block_of[entry]]]
            counts = block_begin[own + 1] - block_begin[own]
            posting = np.repeat(block_begin[own] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
            scores += np.bincount(self.docs[posting], weights=self.impacts[posting], minlength=self.size)
            if self.size >= k:
                least = np.partition(scores, self.size - k)[self.size - k]
            take *= 4
        return self._best(scores, k, done)

    def _whole(self, ats: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Scores of all documents for each query: products of matrices for terms that are frequent on both sides, lists for others.

        Sums of whole numbers below 2**53 are exact in either way.
        """
        step = max(1, CELLS // max(1, self.size))
        for begin in range(0, len(ats), step):
            some = ats[begin : begin + step]
            places = np.concatenate(some)
            query = np.repeat(np.arange(len(some)), [len(at) for at in some])
            terms, place, asked = np.unique(places, return_inverse=True, return_counts=True)
            often = asked * (self.starts[terms + 1] - self.starts[terms]) * SPARSE >= len(some) * self.size
            number = np.cumsum(often) - 1  # of a frequent term
            dense, by_list = terms[often], ~often[place]
            scores = np.zeros((len(some), self.size))
            width = max(16, step)
            for low in range(0, len(dense), width):
                own = dense[low : low + width]
                impacts = np.zeros((len(own), self.size))
                counts = self.starts[own + 1] - self.starts[own]
                docs, values = self._cut([self.docs, self.impacts], self.starts[own], self.starts[own + 1])
                impacts[np.repeat(np.arange(len(own)), counts), docs] = values
                here = ~by_list & (number[place] >= low) & (number[place] < low + width)
                member = np.zeros((len(some), len(own)))
                member[query[here], number[place[here]] - low] = 1
                scores += member @ impacts
            rest = np.split(places[by_list], np.searchsorted(query[by_list], np.arange(1, len(some))))
            for row, at in zip(scores, rest):
                if len(at):
                    docs, values = self._cut([self.docs, self.impacts], self.starts[at], self.starts[at + 1])
                    row += np.bincount(docs, weights=values, minlength=self.size)
                yield row


def _search(shard: Shard, block: dict, k: int) -> pa.RecordBatch:
    """One piece of a shard for a block of queries."""
    numbers, wanted, asked, sizes, least = (np.frombuffer(block[n], kind) for n, kind in BLOCK_KINDS.items())
    lists = shard.lists(wanted, asked, sizes)
    late = np.flatnonzero(least == 0)
    found = [(i, place, score) for i, (place, score, _) in zip(late.tolist(), shard.search_all([lists[i] for i in late], k))]
    early = np.flatnonzero(least > 0)
    found += [(early[i], place, score) for i, place, score in shard.reaching([lists[i] for i in early], k, least[early])]
    out = [(np.full(len(place), numbers[i]), shard.ids[place], score.astype(np.int64)) for i, place, score in found]
    columns = [pa.array(np.concatenate([np.empty(0, np.int64), *x]), pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 3
    return pa.RecordBatch.from_arrays(columns, ["query", "doc", "score"])


def _pairs(k: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a piece of a shard and a block of queries; those of a piece follow each other.

    A piece comes with its first block, and a block with the first piece; later pairs only name them.
    """
    pa.default_memory_pool().release_unused()
    piece, shard, blocks = None, None, {}
    for batch in source:
        names = batch.select(["shard", "piece", "block"]).to_pylist()
        rows = _views(batch)
        for name in names:
            row = rows.pop(0)
            if piece != (name["shard"], name["piece"]):
                piece, shard = (name["shard"], name["piece"]), None
            if row["ids"] is not None:
                shard = Shard.stored({n: row[n].to_pybytes() for n in READY})
            if row["numbers"] is not None:
                blocks[name["block"]] = {n: row[n].to_pybytes() for n in BLOCK_KINDS}
            if shard is None or name["block"] not in blocks:
                raise RuntimeError("pairs of pieces and blocks are not in the order of a Cartesian product")
            yield _search(shard, blocks[name["block"]], k)
        batch = row = None  # not held while the next one comes


def _every_pair(some: DataFrame, blocks: DataFrame, parts: int, k: int) -> DataFrame:
    """Every block asks every piece, without a shuffle: tasks read their pieces and one of some parts of the blocks."""

    def pairs(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pairs(k, source)

    blocks = blocks.coalesce(parts)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its partition
    some, blocks = some.withColumn("first_piece", first), blocks.withColumn("first_block", first)
    sent = [F.when(F.col("first_block"), F.col(n)).alias(n) for n in READY] + [F.when(F.col("first_piece"), F.col(n)).alias(n) for n in BLOCK_KINDS]
    pair = some.hint("shuffle_replicate_nl").crossJoin(blocks).select("shard", "piece", "block", *sent)
    return pair.mapInArrow(pairs, "query long, doc long, score long")


def _waves(shards: list[int]) -> list[int]:
    """The wave of each shard, in an order that follows neither tasks nor ids."""
    order = sorted(range(len(shards)), key=lambda i: xxhash.xxh64_intdigest(str(shards[i])))
    waves, first, wave = [0] * len(shards), 0, 0
    while first < len(shards):
        end = max(1, first * WAVE)
        end = end if end * 2 < len(shards) else len(shards)
        for i in order[first:end]:
            waves[i] = wave
        first, wave = end, wave + 1
    return waves


def _merged(parts: list[tuple[int, int, int, int]]) -> dict[int, int]:
    """The shard of each part, given as its number, topic, documents and postings: parts of a topic up to a shard's limits."""
    out, shard = {}, -1
    topic = docs = postings = None
    for number, own, n, m in sorted(parts, key=lambda p: (p[1], p[0])):
        if own != topic or docs + n > SHARD_DOCS or postings + m > SHARD_POSTINGS:
            shard, topic, docs, postings = shard + 1, own, 0, 0
        out[number], docs, postings = shard, docs + n, postings + m
    return out


def _stored(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """``materialize`` for large binary values: by zstd, as the buffers of snappy lie outside the heap and stay there."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _few_bytes(spark: SparkSession) -> None:
    """Lowers the bytes that Spark hands to Python at once to about one pair; the setting is never raised."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def _views(table: pa.Table | pa.RecordBatch) -> list[dict]:
    """Rows of binary columns without copies."""
    names = [f.name for f in table.schema if pa.types.is_binary(f.type)]
    return [{n: table.column(n)[i].as_buffer() for n in names} for i in range(table.num_rows)]


def top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "query_id",
    query_text_col: str = "text",
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """The ``k`` best documents for each query: ``query_id, rank, doc_id, score``.

    Documents and queries are whole texts; their terms are runs of letters and digits, A-Z in lower case, and a query
    asks for each of its distinct terms once. ``score`` is BM25 with ``idf = ln(1 + (N - n + 0.5) / (n + 0.5))`` in
    millionths. Only documents with a score above zero are results, so a query of no terms has none. Ties go to the
    smaller id. Ids are integers; null query ids are left out, and documents without id come last among equals. Rows
    that share an id are documents (or queries, whose results then share ranks) of their own. Empty tables give an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    _few_bytes(spark)
    asked = pack(queries, query=F.col(f"`{query_id_col}`").cast("long"), text=query_text_col).where("query is not null")
    asked = _stored(arrow_map(asked, _query_terms, "query long, terms binary, size long").where("size > 0"), "queries")
    count, size = asked.agg(F.count("*"), F.sum("size")).first()
    spread = 1 + (size or 0) // TASK_TERMS
    share = max(1, count // SAMPLE, (size or 0) // BLOCK_TERMS)
    sample = asked.where(F.pmod(F.xxhash64("terms"), F.lit(share)) == 0).select("terms").collect()
    topics = Topics([np.frombuffer(r["terms"], "<u8") for r in sample])  # at most some megabytes of queries

    def query_topics(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _query_topics(topics, batch)

    def indexed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _index(source, topics)

    asked = arrow_map(asked, query_topics, "query long, terms binary, size long, topic int")
    asked = _stored(asked.withColumn("kind", F.floor(2 * F.log2("size")).cast("int")), "queries")
    weights = asked.groupBy("topic", "kind").agg(F.sum(F.col("size") + 64).alias("weight")).collect()
    kinds = _blocks({(r["topic"], r["kind"]): r["weight"] for r in weights})
    block = F.lit(0).cast("long")
    for (topic, kind), (first, blocks) in kinds.items():
        own = F.lit(first) + F.pmod(F.xxhash64("query", "terms"), F.lit(blocks))
        block = F.when((F.col("topic") == topic) & (F.col("kind") == kind), own.cast("long")).otherwise(block)
    asked = asked.select("query", "terms", "topic", block.alias("block"))

    rows = pack(docs, id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    index = _stored(rows.mapInArrow(indexed, INDEX_SCHEMA), "index")
    parts = index.select("shard", "topic", "n_docs", "n_words", (F.length("docs") / 2).cast("long").alias("postings")).collect()
    total, words = sum(r["n_docs"] for r in parts), sum(r["n_words"] for r in parts)
    # one number for each part that a task made of a topic
    dealt = _merged([(r["shard"], r["topic"], r["n_docs"], r["postings"]) for r in parts])
    waves = {}
    for topic in {r["topic"] for r in parts}:
        own = sorted({dealt[r["shard"]] for r in parts if r["topic"] == topic})
        waves |= dict(zip(own, _waves(own)))
    of = spark.createDataFrame(list(dealt.items()), "shard long, whole long")
    index = index.join(F.broadcast(of), "shard")
    # document frequencies over all shards: a sum for each term, reduced by part before the shuffle
    local = arrow_map(index.select("whole", "terms", "starts"), _frequencies, "whole long, term long, docs long")
    everywhere = local.groupBy("term").agg(F.sum("docs").alias("n"))
    idf = F.log(1 + (F.lit(float(total)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = local.join(everywhere, "term").select("whole", "term", idf.alias("idf"))
    mean = words / total if total else 0.0

    def ready(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pieces of a shard with the contributions of their postings; a shard has a bounded number of terms."""
        terms, first = np.unique(right.column("term").to_numpy().view(np.uint64), return_index=True)
        idf = right.column("idf").to_numpy()[first]
        whole = left.column("whole")[0].as_py()
        made = []
        for row in _views(left):
            made.append(Shard(row, idf[np.searchsorted(terms, np.frombuffer(row["terms"], "<u8"))], mean, k1, b))
        one = lambda value, kind: pa.array([value], kind)
        there = {"wave": one(waves[whole], pa.int32()), "topic": one(left.column("topic")[0].as_py(), pa.int32())}
        batches = []
        for i, piece in enumerate(Shard.pieces(made)):  # a batch each: the executor takes one at a time
            names = {"shard": one(whole, pa.int32()), "piece": one(i, pa.int32())}
            batches.append(piece.batch(**names, **there, own=one(i > 0, pa.bool_())))
        return pa.Table.from_batches(batches)

    kind = "shard int, piece int, wave int, topic int, own boolean, " + ", ".join(f"{n} binary" for n in READY)
    shards = index.groupBy("whole").cogroup(weights.groupBy("whole")).applyInArrow(ready, kind)
    shards = shards.select("shard", "piece", *READY, "wave", "topic", "own")
    shards = _stored(shards, "shards", "wave", "topic", "own")
    best = spark.createDataFrame([], "query long, doc long, score long, place int")
    last = max(waves.values(), default=-1)
    stored = {(r["topic"], waves[dealt[r["shard"]]]) for r in parts}
    held, asking = {t for t, _ in stored}, {t for t, _ in kinds}
    if last == 0 and any(t != q for t in held for q in asking):
        last = 1
    for wave in range(last + 1):
        # the k-th best score so far; queries that share an id share their results
        least = best.where(F.col("place") == k).select("query", F.col("score").cast("double").alias("least"))
        blocks = asked.join(least, "query", "left").na.fill(0.0, "least")
        blocks = _stored(blocks.groupBy("block").applyInArrow(_query_block, BLOCK_SCHEMA), "query-blocks", "topic")
        best = best.drop("place")
        # queries meet the first shards of other topics one wave later, with a score to reach
        for topic in sorted(held):
            here = (F.col("wave") == wave) & (F.col("topic") == topic)
            if topic in asking and (topic, wave) in stored:
                own = shards.where(here & F.col("own") if wave else here & ~F.col("own"))
                best = best.unionByName(_every_pair(own, blocks.where(F.col("topic") == topic), spread if wave else 6 * spread, k))
            if wave and asking - {topic} and (wave == 1 or (topic, wave) in stored):
                here = (F.col("wave") <= 1 if wave == 1 else F.col("wave") == wave) & (F.col("topic") == topic)
                other = shards.where(here & ~F.col("own"))
                best = best.unionByName(_every_pair(other, blocks.where(F.col("topic") != topic), spread, k))
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")))
        best = best.where(F.col("place") <= k)
        if wave < last:
            best = materialize(best, "best")
    doc: Column = F.when(F.col("doc") != F.lit(int(NO_ID)), F.col("doc"))
    return best.select(F.col("query").alias("query_id"), F.col("place").cast("int").alias("rank"), doc.alias("doc_id"), "score")
