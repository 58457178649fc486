from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ridgeline.llm.lines import LineRuns, drop_repeated_lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def expected(rows, least=3, size=20):
    count, owner = defaultdict(int), {}
    for number, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            count[k] += 1
            if number is not None:
                owner[k] = max(owner.get(k, number), number)
    out = []
    for number, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= size and count[key(x)] >= least and owner.get(key(x)) != number)]
        out.append((number, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rng = random.Random(4)
    pool = ["The quick brown fox jumps", " the QUICK brown fox jumps\t", "short", "ÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉÉ", "éééééééééééééééééééé", "", "z" * 20, "z" * 19, "\x0bz" + "y" * 25]
    rows = [(0, None), (1, ""), (2, "\n"), (3, "w" * 50_000)]
    for i in range(60):
        rows.append((None if i % 11 == 0 else i % 50, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))))
    rows.append(rows[-1])
    frame = spark.createDataFrame([(*r, "a", 5) for r in rows], "doc_id long, text string, gone string, stray int")
    out = drop_repeated_lines(frame, fanout=2)
    assert out.columns == ["doc_id", "text", "gone", "stray", "n_lines", "n_dropped"]
    assert sorted([tuple(r) for r in out.drop("gone", "stray").collect()], key=str) == expected(rows)
    many = drop_repeated_lines(frame, batch_lines=20, fanout=2)
    assert sorted([tuple(r) for r in many.drop("gone", "stray").collect()], key=str) == expected(rows)
    assert drop_repeated_lines(frame.limit(0)).count() == 0


def test_batches_follow_the_number_of_lines(spark, monkeypatch):
    seen = []
    put = LineRuns._put

    def watched(self, level, run):
        seen.append(level)
        put(self, level, run)

    monkeypatch.setattr(LineRuns, "_put", watched)
    rows = [(i, f"a line that is in all documents\nthe line of document number {i}") for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for options, batches in (({}, 8), ({"batch_lines": 20}, 12)):
        seen.clear()
        kept = drop_repeated_lines(frame, **options).where("n_dropped = 0").collect()
        assert [r.doc_id for r in kept] == [119]
        assert seen.count(0) == batches and seen.count(1) == batches // 3  # a compaction for each three runs
    assert seen.count(2) == 1


def test_runs_are_compacted_and_know_old_lines(spark):
    runs = LineRuns(spark, fanout=2)
    batches = [[(9, "a"), (8, "a"), (9, "b")], [(5, "a"), (5, "c")], [(2, "c")], [(1, "d"), (1, "a")]]
    for batch in batches:
        frame = spark.createDataFrame([(d, x.encode()) for d, x in batch], "doc long, line binary")
        known = runs.all()
        fresh = {bytes(r.line) for r in runs.new_lines(frame).collect()}
        old = set() if known is None else {bytes(r.line) for r in known.collect()}
        assert fresh == {x.encode() for _, x in batch} - old
        runs.add(frame)
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    total = {(bytes(r.line).decode(), r.docs, r.owner) for r in runs.totals().collect()}
    assert total == {("a", 4, 9), ("b", 1, 9), ("c", 2, 5), ("d", 1, 1)}
    assert runs.totals().select(F.count("line")).first()[0] == 4
