from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridgeline.llm.packing import SHIFT, WordEncoder, class_patterns, nonnegative_fit, pack_documents, pack_lengths
from ridgeline.llm.queries import op13_best_fit_packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts):
    library = Tokenizer.from_file(VOCABULARY)
    return [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def plain_best_fit(lengths, limit):
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else limit
        used += room == limit
        if room > n:
            insort(rooms, room - n)
    return used


def check(rows, got, limit):
    """Pieces are those of the library, and sequences are without gaps."""
    wanted = []
    for (number, _), ids in zip(rows, library_ids([t for _, t in rows])):
        for piece, start in enumerate(range(0, len(ids), limit)):
            cut = ids[start : start + limit]
            wanted.append((number, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(wanted, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= limit
    total = sum(r.length for r in got)
    assert len(sequences) >= -(-total // limit)
    return len(sequences)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = op13_best_fit_packing(spark, folder).collect()
    lengths = [r.length for r in got]
    assert check(rows, got, 4096) <= plain_best_fit(lengths, 4096)


def test_odd_rows(spark):
    rng = random.Random(5)
    alphabet = "abc XYZ 0129 .,!' \t\n\r\x1c\x85 　éÉßİıΣςſ²½中文字́ͅﬁ😀<|endoftext|> <|startoftext|>"
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "word " * 5000), (5, "x" * 3000), (None, "no id"), (None, "no id"), (6, "it's we'll ''s 'LL <|endoftext|>")]
    rows += [(10 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))) for i in range(400)]
    rows += [(1000, "the same text again")] * 300  # copies and one id
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, offset int").repartition(9)
    got = pack_documents(frame, VOCABULARY, limit=128)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    found = got.collect()
    assert check(rows, found, 128) <= 1.01 * plain_best_fit([r.length for r in found], 128)
    assert pack_documents(frame.limit(0), VOCABULARY).count() == 0


def test_encoder_equals_library():
    rng = random.Random(6)
    pool = [chr(c) for c in [*range(1, 0x250), 0x301, 0x345, 0x3A3, 0x2028, 0x1E9E, 0xFB01, 0x1F600]] + [" "] * 150 + list("'stremvld") * 20
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    encoder = WordEncoder(open(VOCABULARY, "rb").read())
    library = Tokenizer.from_file(VOCABULARY)
    got = list(encoder.encode(texts[:2000])) + list(encoder.encode(texts[2000:]))
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def spread(plan, histogram):
    """Sequence and offset of every piece of a plan."""
    length = np.repeat(np.array(list(histogram), np.int64), list(histogram.values()))
    number = np.concatenate([np.arange(n) for n in histogram.values()])
    row = np.searchsorted(plan.key, (length << SHIFT) + number, side="right") - 1
    among = number - plan.first[row]
    return length, plan.sequence[row] + among // plan.each[row], plan.offset[row] + among % plan.each[row] * length


@pytest.mark.parametrize("kind", ["short", "mixed", "long", "hot", "halves", "one"])
def test_plans(kind):
    rng = np.random.default_rng(1)
    limit = 512
    lengths = {
        "short": rng.integers(1, 20, 5000),
        "mixed": np.minimum(rng.exponential(120, 20_000).astype(int) + 1, limit),
        "long": rng.integers(150, 330, 5000),
        "hot": np.concatenate([np.full(4000, 171), rng.integers(1, limit + 1, 8000)]),
        "halves": np.full(1001, 256),
        "one": np.array([3]),
    }[kind]
    values, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist()))
    plan = pack_lengths(histogram, limit)
    length, sequence, offset = spread(plan, histogram)
    order = np.lexsort((offset, sequence))
    length, sequence, offset = length[order], sequence[order], offset[order]
    first = np.r_[True, sequence[1:] != sequence[:-1]]
    assert (offset[first] == 0).all() and (offset[1:][~first[1:]] == (offset + length)[:-1][~first[1:]]).all()
    assert (offset + length).max() <= limit and len(np.unique(sequence)) == plan.sequences
    assert plan.sequences <= 1.002 * plain_best_fit(lengths.tolist(), limit) + 1
    many = pack_lengths({n: 1000 * c for n, c in histogram.items()}, limit)
    assert len(many.key) <= 4 * limit * 33  # the plan does not grow with the pieces
    assert many.sequences <= 1000 * plan.sequences


def test_patterns_are_complete():
    for units, most in ((7, 3), (12, 4)):
        wanted = {c for k in range(1, most + 1) for c in combinations_with_replacement(range(1, units + 1), k) if sum(c) == units}
        got = [tuple(np.repeat(np.arange(units + 1), row.astype(int))) for row in class_patterns(units, most)]
        assert sorted(map(tuple, map(lambda c: [int(v) for v in c], got))) == sorted(wanted)


def test_fit_is_the_best_nonnegative_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((6, 12)), rng.normal(size=6)
        x = nonnegative_fit(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) <= 1e-6
