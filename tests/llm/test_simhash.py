from __future__ import annotations

import random

import numpy as np
import xxhash

from ridgeline.llm.components import components
from ridgeline.llm.simhash import fingerprint, keep_one_of_each, near_fingerprints, simhash_components

SCHEMA = "doc_id long, text string, fingerprint int, part int"


def plain_fingerprint(text, words=4):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    width = min(words, len(parts))
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + width]), 42) for i in range(len(parts) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(count, near):
    """Smallest index reachable from each, by brute force."""
    label = list(range(count))
    for start in range(count):
        if label[start] != start:
            continue
        stack = [start]
        while stack:
            at = stack.pop()
            for other in range(count):
                if label[other] > start and near(at, other):
                    label[other] = start
                    stack.append(other)
    return label


def test_fingerprint_equals_plain_one():
    for text in (None, "", " \t\n", "one", "A b\x0bC", "a b c d", "x " * 400, "É é ß İ", "w" * 100_000 + " b c d e f"):
        assert fingerprint(text) == plain_fingerprint(text)


def test_odd_rows(spark):
    rng = random.Random(1)
    base = " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(300)).split()
    rows = [(i, text) for i, text in enumerate([None, "", "  ", "one", "One", "one two"])]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new"
        rows.append((None if i % 9 == 0 else 100 - i, " ".join(words)))
    rows += rows[-3:]  # repeated rows
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    prints = [plain_fingerprint(t) for _, t in rows]
    label = groups(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    lowest = {}
    for (number, _), at in zip(rows, label):
        if number is not None:
            lowest[at] = min(lowest.get(at, number), number)
    expected = sorted([(n, f"{p:016x}", lowest.get(at)) for (n, _), p, at in zip(rows, prints, label)], key=str)
    got = sorted([tuple(r) for r in simhash_components(frame).collect()], key=str)
    assert got == expected
    kept = keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(set(lowest.values()))
    assert simhash_components(frame.limit(0)).count() == 0


def test_large_tries_are_walked_in_parts(spark):
    rng = np.random.default_rng(0)
    prints = set(rng.integers(0, 2**64, 200, dtype=np.uint64).tolist())
    for center in rng.integers(0, 2**64, 4, dtype=np.uint64).tolist():
        for _ in range(120):
            value = center
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                value ^= 1 << int(bit)
            prints.add(value)
    prints = sorted(prints)
    label = groups(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    for limit, chunk in ((20, 50), (100, 100), (60_000, 150_000)):
        root = {r.node & (2**64 - 1): r.root for r in components(near_fingerprints(frame, 3, limit, chunk)).collect()}
        got = [root.get(p, p) for p in prints]
        assert len(set(zip(got, label))) == len(set(got)) == len(set(label))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5), (None, 3), (7000, 6999), (6999, 7000)]
    root = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert root == {i: 0 for i in range(61)} | {2000 + i: 1000 for i in range(300)} | {1000: 1000, 7000: 6999, 6999: 6999}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
