from __future__ import annotations

import hashlib
import random
from functools import partial

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridgeline.llm.bpe import TextCodec, TokenAutomaton, codec_digest, decode_ids, encode_texts, with_tokens
from ridgeline.llm.common import arrow_map, shipped_file
from ridgeline.llm.token_count import WordCounter, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = "aab e \n\t'st'll<|endoftext|>.,!?-=_\x1c\x1f\x85\xa0éÉßΣσςİıǅﬁ́̀ 　中文字😀👍🏽２½Ⅷ²‍﻿\x00"
ODD = ["", " ", "a" * 3000, "-" * 900, "<|endoftext|><|startoftext|>x<|endoftext|>", " <|endoftext|> ", "A<|ENDOFTEXT|>", " " * 99, "ΟΔΟΣ ΟΔΟΣ"]


def odd_texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


def test_helpers_equal_the_library(libraries):
    words, plain = libraries
    with open(WORDS, "rb") as a, open(BYTES, "rb") as b:
        counter, codec = WordCounter(a.read()), TextCodec(b.read())
    import numpy as np

    for text in odd_texts():
        assert counter.tokens(text) == len(words.encode(text, add_special_tokens=False).ids), repr(text)
        ids = plain.encode(text, add_special_tokens=False).ids
        mine = np.frombuffer(codec.encode(text), "<u4")
        assert mine.tolist() == ids, repr(text)
        assert codec.decode(mine) == plain.decode(ids, skip_special_tokens=False)


def merged(word: bytes, merges):
    """Byte-pair encoding as it is defined."""
    parts = [bytes([b]) for b in word]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        at = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30), default=None)
        if at is None or (parts[at], parts[at + 1]) not in rank:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=12), st.text("ab", max_size=24))
def test_automaton_accepts_what_merging_makes(choices, word):
    tokens, merges = [b"a", b"b"], []
    for choice in choices:  # merges of a random small vocabulary
        a, b = tokens[choice % len(tokens)], tokens[choice // 1000 % len(tokens)]
        if a + b not in tokens:
            merges.append((a, b))
            tokens.append(a + b)
    automaton = TokenAutomaton({t: i for i, t in enumerate(tokens)}, merges)
    if word:
        assert [automaton.label[i] for i in automaton.encode(word.encode())] == merged(word.encode(), merges)


def test_tables_with_odd_rows(spark, libraries):
    words, plain = libraries
    texts = [None, *ODD, "same", "same"]
    rows = [(None if i == 3 else i // 2, t, 7, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = sorted([tuple(r) for r in token_counts(frame, WORDS, limit=5).collect()], key=str)
    count = lambda t: len(words.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted([(r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 5) for r in rows], key=str)

    def digest(row):
        ids = plain.encode(row[1] or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        text = plain.decode(ids, skip_special_tokens=False)
        return (row[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())

    assert sorted([tuple(r) for r in codec_digest(frame, BYTES).collect()], key=str) == sorted(map(digest, rows), key=str)
    back = decode_ids(encode_texts(frame, BYTES), BYTES)
    assert sorted([tuple(r) for r in back.collect()], key=str) == sorted([(r[0], r[1] or "") for r in rows], key=str)
    both = with_tokens(frame, BYTES)
    assert both.columns == ["doc_id", "text", "ids", "n_tokens", "round_trip"] and both.where("not round_trip").count() == 0
    assert decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), BYTES).collect()[0].text is None
    for empty in (token_counts(frame.limit(0), WORDS), codec_digest(frame.limit(0), BYTES)):
        assert empty.count() == 0


def test_workers_forget_what_other_operators_built(spark):
    frame = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "doc_id long, text string").coalesce(1)

    def held(batch):
        from ridgeline.llm import common

        return pa.RecordBatch.from_arrays([pa.array([len(common._BUILT)] * batch.num_rows, pa.int64())], ["held"])

    def building(file, batch):
        file.build(TextCodec)
        return held(batch)

    for _ in range(2):
        built = arrow_map(frame, partial(building, shipped_file(spark, BYTES)), "held long")
        assert min(r.held for r in built.collect()) >= 1
        assert {r.held for r in arrow_map(frame, held, "held long").collect()} == {0}
