from __future__ import annotations

import random

import numpy as np
import xxhash

from ridgeline.llm.components import components
from ridgeline.llm.shingles import _common, keep_one_of_near, near_sets, shingles, trie_groups, without_ids
from ridgeline.llm.simhash import set_fingerprint

import corpus_pipeline

from .test_simhash import groups


def plain_set(text):
    parts = (text or "").encode().lower().split()
    width = min(5, len(parts))
    return {b" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1)} if parts else set()


def kept_by_brute_force(rows):
    sets = [plain_set(text) for _, text in rows]

    def near(a, b):
        union = len(sets[a] | sets[b])
        return union == 0 or len(sets[a] & sets[b]) / union >= 0.8

    lowest = {}
    for (number, _), at in zip(rows, groups(len(rows), near)):
        if number is not None:
            lowest[at] = min(lowest.get(at, number), number)
    return sorted(lowest.values())


def family(rng, size, changes):
    """Copies of one text of 300 words, each with some other words."""
    base = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(300)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 9999)}"
        yield " ".join(words)


def some_rows():
    rng = random.Random(1)
    texts = [None, "", "  ", "one", "One", "one two", "a b c d e", "A b  c d\te"]
    for changes in (2, 4, 6, 8, 10):  # similarities on both sides of the limit, so chains matter
        texts += family(rng, 25, changes)
    return [(None if i % 19 == 5 else 1000 - 3 * i, text) for i, text in enumerate(texts)]


def test_kept_equals_brute_force(spark):
    rows = some_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(5)
    got = keep_one_of_near(frame)
    assert got.columns == frame.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == kept_by_brute_force(rows)
    assert got.where("doc_id is null").count() == sum(number is None for number, _ in rows)
    assert keep_one_of_near(frame.limit(0)).count() == 0


def test_pipeline_stage_links_at_jaccard(spark):
    """Texts within 0.8 whose fingerprints are more than four bits apart are near copies too."""
    rows = [(number, text) for number, text in some_rows() if number is not None]
    frame = spark.createDataFrame([(*r, "en", "web", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copy_stage(spark, frame, "")
    assert got.columns == corpus_pipeline.DOCUMENT
    assert sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    """Parts of a band against each other give the same groups, whatever the size of a part."""
    rng = random.Random(4)
    rows = list(enumerate(t for changes in (9, 12, 15) for t in family(rng, 60, changes)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (7, 1024):
        monkeypatch.setattr("ridgeline.llm.shingles.BLOCK_SETS", size)
        assert sorted(r.doc_id for r in keep_one_of_near(frame).collect()) == kept_by_brute_force(rows)


def test_common_values():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (0, 1, 5000, 6000, 40, 3000)]
    a, b = np.array([0, 2, 4]), np.array([1, 3, 5])
    assert _common(sets, a, b).tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in b] for i in a]


def test_without_ids(spark):
    frame = spark.createDataFrame([(i % 50 if i else None, f"t{i}", i) for i in range(200)], "doc_id int, text string, hashed int").repartition(4)
    gone = spark.range(0, 100, 3).toDF("gone")
    got = without_ids(frame, "doc_id", gone)
    assert got.columns == frame.columns and got.schema == frame.schema
    assert sorted(got.collect(), key=str) == sorted((r for r in frame.collect() if r.doc_id is None or r.doc_id % 3), key=str)
    assert without_ids(frame, "doc_id", gone.limit(0)).count() == 200 and without_ids(frame.limit(0), "doc_id", gone).count() == 0


def signed(number):
    return number - (1 << 64) if number >> 63 else number


def test_tries_find_candidates(spark):
    """Sets within the budget of the tries are candidates: without any band all their links come from there."""
    texts = [text for _, text in some_rows()] + list(family(random.Random(3), 40, 1))
    sets = {signed(xxhash.xxh64_intdigest(s.tobytes())): (s, text) for s, text in ((shingles(t), t) for t in texts)}
    names = list(sets)
    prints = [sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in s.tolist()) > len(s)) for s, _ in sets.values()]
    assert prints == [set_fingerprint(s) for s, _ in sets.values()]
    rows = [(d, signed(p), [], sets[d][1]) for d, p in zip(names, prints)]
    marked = spark.createDataFrame(rows, "digest long, print long, bands array<long>, text string").repartition(3)
    at = list(groups(len(names), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 6))
    together = {}
    for r in trie_groups(marked).collect():
        together.setdefault(r.band, set()).add(r.digest)
    own = {}
    for d, group in zip(names, at):
        own.setdefault(group, set()).add(d)
    assert sorted(map(sorted, together.values())) == sorted(sorted(g) for g in own.values() if len(g) > 1)

    def near(a, b):
        one, other = plain_set(sets[names[a]][1]), plain_set(sets[names[b]][1])
        return at[a] == at[b] and len(one & other) >= 0.8 * len(one | other)

    label = list(groups(len(names), near))
    expected = {frozenset(d for d, x in zip(names, label) if x == group) for group in label if label.count(group) > 1}
    got = {}
    for r in components(near_sets(marked, 5, 0.8)).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert set(map(frozenset, got.values())) == expected and len(expected) > 1
