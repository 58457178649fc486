"""Line deduplication with levelled sorted runs of line hashes.

``LineRuns`` keeps what earlier batches held as runs: tables of (line hash, documents, owner), sorted by hash. A new
batch is reduced to its own sorted hashes and anti-joined with the runs: hashes that no run has are *fresh*,
and only for them does the batch name an owner. The batch then becomes a run of level 0; when a level
has ``fanout`` runs they are compacted into one run of the next level. Each hash is rewritten once for each level, so
the work for a batch does not grow with the number of batches before it.

Batches come in descending order of document ids, so the owner of a line is the largest document that holds it. Their
number follows from the number of line hashes, so a batch does not grow with the input.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.llm.common import arrow_map, fresh, materialize, pack

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """What makes two lines equal: no blanks at the ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _long_keys(text: str | None, least: int) -> set[bytes]:
    keys = {line_key(line) for line in (text or "").encode().split(b"\n") if len(line) >= least}
    return {_hash(key) for key in keys if len(key) >= least and _points(key) >= least}


def _line_rows(least: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, hashes = [], []
    for at, value in enumerate(batch.column(2)):
        found = _long_keys(value.as_py(), least)
        rows += [at] * len(found)
        hashes += found
    at = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes, pa.binary())], ["doc", "stray", "line"]
    )


class LineRuns:
    """Runs of line hashes, level by level; all of them live in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        if fanout < 2:
            raise ValueError("a level holds at least two runs")
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        out = None
        for run in runs:
            out = run if out is None else out.unionByName(run)
        return out

    @staticmethod
    def _store(rows: DataFrame) -> DataFrame:
        return materialize(rows.sortWithinPartitions("line"), "line-run")

    def add(self, lines: DataFrame) -> None:
        """Takes in the lines (``doc``, ``line``) of one batch, each line at most once for a document."""
        own = lines.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("owner"))
        known = self.all()
        if known is not None:
            own = materialize(own, "line-batch")
            # only fresh hashes claim an owner; of known ones the documents are counted
            seen = own.join(known.select("line"), "line", "left_semi").withColumn("owner", F.lit(None).cast(own.schema["owner"].dataType))
            own = self.new_lines(own).unionByName(seen)
        self._put(0, self._store(own))

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """The rows of a batch whose line no run has yet."""
        known = self.all()
        return lines if known is None else lines.join(known.select("line"), "line", "left_anti")

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            together, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._store(self._merged(together)))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        # only one run at most names an owner
        return out.groupBy("line").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def totals(self) -> DataFrame | None:
        """One row for each hash: in how many documents, and its owner."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else None


def _without(text: str | None, gone: list[bytes] | None, least: int) -> tuple[str | None, int, int]:
    lines = (text or "").encode().split(b"\n")
    if text is None or not gone:
        return text, len(lines), 0
    leave = set(gone)
    kept = []
    for line in lines:
        key = line_key(line) if len(line) >= least else b""
        if len(key) < least or _points(key) < least or _hash(key) not in leave:
            kept.append(line)
    return b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)


def _cut(least: int, text_at: int, gone_at: int, names: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, sizes, dropped = [], [], []
    for text, gone in zip(batch.column(text_at), batch.column(gone_at)):
        one, size, lost = _without(text.as_py(), gone.as_py(), least)
        texts.append(one)
        sizes.append(size)
        dropped.append(lost)
    kept = [batch.column(i) for i in range(batch.num_columns) if i != gone_at]
    kept[text_at] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64())], names)


def _batches(lines: DataFrame, number: int) -> list[DataFrame]:
    """Stored lines in ranges of ids, largest ids first; files that hold no id of a range are passed over."""
    doc = F.col("doc")
    parts = [i / number for i in range(1, number)]
    cuts = lines.select(F.percentile_approx("doc", parts, 100 * number).alias("cuts")).first().cuts if parts else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [lines]
    middle = [lines.where((doc > low) & (doc <= high)) for low, high in zip(cuts, cuts[1:])]
    # a null id is smaller than every other id
    return [lines.where(doc > cuts[-1]), *reversed(middle), lines.where(doc.isNull() | (doc <= cuts[0]))]


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    batches: int = 8,
    batch_lines: int = 1 << 28,
    fanout: int = 3,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """All rows and columns of ``docs``, the texts without repeated lines, and two counts.

    A line whose key (stripped of blanks, A-Z lower-cased) has ``min_chars`` code points or more and is in
    ``min_docs`` documents or more stays only in the document with the largest id (a number) that has it. A null text has one
    empty line and stays null. Each row counts as one document. Rows with one id are parts of one document when lines
    are dropped: all of them keep a line that their id owns. A null id is smaller than every other id, and lines that
    only rows without id have stay everywhere. An empty table gives an empty result. ``n_lines`` and ``n_dropped``
    replace columns of those names. The work is cut into ``batches`` batches, or more where they would have over
    ``batch_lines`` line hashes; this changes no result.

    Shuffled are 16-byte hashes of lines, summed up before the shuffle, and once the texts. A line that a third of all
    documents has is one row for each map task.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n_lines.lower(), n_dropped.lower()}])
    stray, gone = fresh(docs.columns, "stray"), fresh(docs.columns, "gone")
    # rows without id are told apart by their text
    docs = docs.withColumn(stray, F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.col(f"`{text_col}`"))))
    rows = pack(docs, doc=id_col, stray=stray, text=text_col)
    kind = rows.schema["doc"].dataType.simpleString()
    lines = arrow_map(rows, partial(_line_rows, min_chars), f"doc {kind}, stray long, line binary")
    lines = materialize(lines, "lines")
    runs = LineRuns(docs.sparkSession, fanout)
    for batch in _batches(lines, max(batches, -(-lines.count() // batch_lines))):
        runs.add(batch)
    # stored, so that both sides of the join are dealt out anew and a line that very many documents have can be split
    repeated = materialize(runs.totals().where(F.col("docs") >= min_docs).select("line", "owner"), "repeated-lines")
    lost = (
        lines.join(repeated, "line")
        .where(~F.col("doc").eqNullSafe(F.col("owner")))
        .groupBy(F.col("doc").alias("doc_"), F.col("stray").alias("stray_"))
        .agg(F.collect_set("line").alias(gone))  # at most the lines of the document itself
    )
    mine = docs.join(lost, docs[f"`{id_col}`"].eqNullSafe(lost["doc_"]) & docs[f"`{stray}`"].eqNullSafe(lost["stray_"]), "left")
    mine = mine.select(*[docs[f"`{c}`"] for c in docs.columns if c != stray], lost[gone])
    schema = StructType([f for f in mine.schema.fields if f.name != gone]).add(n_lines, "long").add(n_dropped, "long")
    work = partial(_cut, min_chars, mine.columns.index(text_col), mine.columns.index(gone), schema.names)
    return arrow_map(mine, work, schema)
