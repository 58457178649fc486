from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm.suffix import NO_ID, blind_trie, cut_repeats, deep_shallow


def expected(rows, width=50):
    first = {}
    raws = [((NO_ID if n is None else n), (t or "").encode()) for n, t in rows]
    for rank, raw in raws:
        for at in range(len(raw) - width + 1):
            piece = raw[at : at + width]
            first[piece] = min(first.get(piece, rank), rank)
    out = []
    for (number, _), (rank, raw) in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for at in range(len(raw) - width + 1):
            if first[raw[at : at + width]] < rank:
                gone[at : at + width] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((number, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(frame, **options):
    rows = cut_repeats(frame, **options).collect()
    return sorted([(r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows], key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=6), min_size=1, max_size=30))
def test_blind_trie_sorts(strings):
    strings = [s.encode() for s in strings]
    order, kind = blind_trie(strings)
    assert [strings[i] for i in order] == sorted(strings)
    assert all((kind[i] == kind[j]) == (strings[i] == strings[j]) for i in range(len(strings)) for j in range(len(strings)))


def test_deep_shallow_finds_equal_suffixes():
    rng = np.random.default_rng(0)
    rows = np.repeat(rng.integers(97, 99, (40, 50), dtype=np.uint8), 3, axis=0)
    rows[::7, 30:] = 97
    group = rng.integers(0, 3, len(rows))
    label = np.arange(len(rows))
    for at, kind in deep_shallow(group, rows):
        for value in np.unique(kind):
            label[at[kind == value]] = at[kind == value].min()
    keys = [(g, r.tobytes()) for g, r in zip(group, rows)]
    assert all((label[i] == label[j]) == (keys[i] == keys[j]) for i in range(len(rows)) for j in range(len(rows)))


def test_odd_rows(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdef éß\n") for _ in range(300)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 9000), (0, "ab" * 40)]
    for i in range(120):
        text = "".join(rng.choice(base)[rng.randint(0, 250) :][: rng.randint(0, 160)] for _ in range(rng.randint(0, 4)))
        rows.append((rng.choice([i, i, i, None, 5]), rng.choice([text, text, text, "", text + text, "ab " * rng.randint(1, 60)])))
    frame = spark.createDataFrame([(*r, "p", 0) for r in rows], "doc_id long, text string, part string, n_bytes int")
    assert result(frame) == expected(rows)
    assert result(frame.repartition(3), part_bytes=2000) == expected(rows)
    # all that parts share is dealt out string by string
    assert result(frame.repartition(4), part_bytes=1000, hot_parts=1) == expected(rows)
    assert result(frame.limit(0)) == []


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()][:80]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)
