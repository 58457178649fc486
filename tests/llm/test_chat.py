from __future__ import annotations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from ridgeline.llm.chat import rendered, rotate_perspectives
from ridgeline.llm.queries import CHAT, CHAT_TURNS

from .comparing import assert_same_rows

SCHEMA = "conv_id long, turn long, role string, text string, piece string, place int"


def test_rendering_masks_what_the_assistant_says():
    text, spans = rendered([("ann", "hi <|end|>"), ("bo|b", None), ("system", "s"), (None, "x")], "ann", frozenset(["system"]))
    assert text == "<|assistant|>\nhi <\\|end|><|end|>\n<|user:bo_b|>\n<|end|>\n<|system|>\ns<|end|>\n<|user:unknown|>\nx<|end|>\n"
    assert [text[b:e] for b, e in spans] == ["hi <\\|end|><|end|>\n"]


def odd_rows():
    rows = [(1, t, r, f"t{t}") for t, r in enumerate(["system", "ann", "bob", "ann", "cy"])]
    rows += [(2, 0, "system", "alone"), (3, None, "ann", "no turn"), (3, 1, None, None), (3, 1, "ann", ""), (3, 1, "ann", "")]
    rows += [(None, 2, "ann", "a"), (None, 1, "bob", "b <|x|> é😀"), (4, 0, "a|b<c>\n", "x" * 70_000)]
    rows += [(5, t // 3, "ann" if t % 3 else "bob", f"text {t % 5}") for t in range(3 * CHAT_TURNS + 5)]  # long, with ties
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)
    chats = rotate_perspectives(frame.repartition(5), turns=CHAT_TURNS)
    marks = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    got = chats.select("conv_id", "perspective", "piece", "n_turns", F.sha2("text", 256).alias("text_sha256"), marks.alias("trained"))
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    assert_same_rows(got, duckdb.sql(CHAT))
    assert rotate_perspectives(frame.limit(0)).count() == 0
