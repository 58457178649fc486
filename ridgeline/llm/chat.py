"""Chat formatting by rotating the perspective of a dialogue.

A dialogue is rendered once for every participant: that speaker becomes the assistant, all others become users with
their names, and only what the assistant says is trained on. System turns are shown to everyone and belong to no one.

A dialogue may be of any length, so it is cut into pieces of ``turns`` turns. Turns are numbered without bringing a
dialogue to one place: a global sort deals out turns by (dialogue, turn, speaker, text), each task counts its own, and
the counts of the tasks before are added. A piece is rendered for each participant by a join on the dialogue.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridgeline.llm.common import arrow_map, materialize, pack
from ridgeline.session import ship_package

OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
BARE = str.maketrans({"|": "_", "<": "_", ">": "_", "\n": "_", "\r": "_"})


def speaker_name(role: str | None) -> str:
    """A name that cannot be taken for markup; speakers that differ in such characters only are shown alike."""
    return (role or "unknown").translate(BARE)


def rendered(turns: list[tuple[str | None, str | None]], assistant: str | None, system: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """A text, and the spans (in code points) that the assistant said, end marks included."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        own = role == assistant
        head = "assistant" if own else "system" if role in system else f"user:{speaker_name(role)}"
        head = f"{OPEN}{head}{CLOSE}\n"
        body = (text or "").replace(OPEN, "<\\|") + END  # a text cannot open markup
        if own:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body]
        at += len(head) + len(body)
    return "".join(parts), spans


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds the place (from 0) of each row among those with its key, in the order of ``order``; null is a key."""
    ship_package(rows.sparkSession)
    kinds = StructType(list(rows.schema.fields)).add("task_", "integer").add("place_", "long")
    at = rows.columns.index(key)

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last, seen = object(), 0
        for batch in source:
            places = np.empty(batch.num_rows, np.int64)
            for i, value in enumerate(batch.column(at).to_pylist()):
                seen = seen + 1 if value == last else 0
                last = value
                places[i] = seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(places), task, np.int32)), pa.array(places)], kinds.names)

    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    # stored, since the numbers of tasks hold for this one run only
    counted = materialize(dealt.mapInArrow(count, kinds), "numbered")
    before = counted.groupBy(F.col(key).alias("key_"), F.col("task_").alias("of_")).agg(F.count(F.lit(1)).alias("size_"))
    span = Window.partitionBy("key_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("before_", F.coalesce(F.sum("size_").over(span), F.lit(0))).where("before_ > 0").drop("size_")
    out = counted.join(before, F.col(key).eqNullSafe(F.col("key_")) & (F.col("task_") == F.col("of_")), "left")
    return out.withColumn(name, F.col("place_") + F.coalesce("before_", F.lit(0))).select(*rows.columns, name)


def _render(system: frozenset[str], batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, spans = [], []
    for speaker, roles, said in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4))):
        text, own = rendered(list(zip(roles, said)), speaker, system)
        texts.append(text)
        spans.append([{"begin": b, "end": e} for b, e in own])
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    size = pa.array([len(x) for x in batch.column(3).to_pylist()], pa.int64())
    return pa.RecordBatch.from_arrays([*batch.columns[:3], size, pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv", "speaker", "piece", "n_turns", "text", "spans"])


def rotate_perspectives(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    turns: int = 64,
    system_roles: tuple[str, ...] = ("system",),
) -> DataFrame:
    """Per dialogue, participant and piece: ``conv_col, perspective, piece, n_turns, text, spans``.

    ``spans`` (begin, end in code points) mark what is trained on. Turns go by number, then speaker, then text, nulls
    first; repeated rows are turns of their own. A null text is an empty turn, a null speaker is a participant named
    unknown, rows without dialogue form one dialogue of their own, and a dialogue of system turns only has no
    participant and no result. An empty table gives an empty result; other columns are not read.
    """
    if turns < 1:
        raise ValueError("a piece has at least one turn")
    rows = pack(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    placed = numbered(rows, "conv", ["turn", "role", "text"], "place")
    held = F.sort_array(F.collect_list(F.struct("place", "role", "text")))  # at most ``turns`` rows
    pieces = placed.withColumn("piece", F.floor(F.col("place") / turns)).groupBy("conv", "piece").agg(held.alias("said"))
    pieces = materialize(pieces.select("conv", "piece", F.col("said.role").alias("roles"), F.col("said.text").alias("texts")), "pieces")
    speakers = placed.where(~F.coalesce(F.col("role").isin(*system_roles), F.lit(False))).select(F.col("conv").alias("of"), F.col("role").alias("speaker")).distinct()
    speakers = materialize(speakers, "speakers")
    both = pieces.join(speakers, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "speaker", "piece", "roles", "texts")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, speaker string, piece long, n_turns long, text string, spans array<struct<begin: long, end: long>>"
    out = arrow_map(both, partial(_render, frozenset(system_roles)), schema)
    return out.select(F.col("conv").alias(conv_col), F.col("speaker").alias("perspective"), "piece", "n_turns", "text", "spans")
