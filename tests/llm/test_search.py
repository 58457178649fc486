from __future__ import annotations

import random
import re
from collections import Counter
from math import log

from ridgeline.llm import search
from ridgeline.llm.search import top_k


def expected(docs, queries, k):
    terms = lambda t: Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
    found = [terms(t) for _, t in docs]
    held = Counter(w for f in found for w in f)
    mean = sum(sum(f.values()) for f in found) / max(len(docs), 1)
    out = []
    for number, text in queries:
        scores = []
        for (doc, _), f in zip(docs, found):
            score = 0
            for word in terms(text):
                if word in f:
                    idf = log(1 + (len(docs) - held[word] + 0.5) / (held[word] + 0.5))
                    score += round(idf * (f[word] * 2.2 / (f[word] + 1.2 * (1 - 0.75 + 0.75 * sum(f.values()) / mean))) * 1e6)
            if score:
                scores.append((-score, search.NO_ID if doc is None else doc))
        out += [(number, i + 1, None if doc == search.NO_ID else doc, -score) for i, (score, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "Zé", "7"]
    docs = [(0, None), (1, ""), (2, " .,"), (3, "w1 " * 20_000 + "w2 " * 255), (None, "w1 w2 é"), (None, "w1 w2 é")]
    docs += [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 60)))) for i in range(4, 400)]
    docs += docs[-8:]  # repeated rows tie
    queries = [(i, t) for i, t in docs if i is not None and i % 20 == 0 and i]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, shard string")
    asked = spark.createDataFrame([(*q, 3) for q in queries] + [(None, "w1", 3), (999, "unknown .", 3)], "query_id long, text string, rank int")
    for k in (1, 10, 500):
        got = sorted([tuple(r) for r in top_k(frame.repartition(4), asked, k=k).collect()], key=str)
        assert got == expected(docs, queries, k)
    assert top_k(frame.limit(0), asked).count() == 0
    assert top_k(frame, asked.limit(0)).count() == 0


def test_blocks_are_left_out_where_no_bound_reaches():
    docs = [search.term_counts(f"common word{i % 7} " + ("rare" if i in (5, 700) else "")) for i in range(1000)]
    row = search._shard(0, list(range(1000)), docs).to_pylist()[0]
    terms = search.np.frombuffer(row["terms"], "<u8")
    counts = search.np.diff(search.np.frombuffer(row["starts"], "<i8"))
    weights = search.np.log(1 + (1000 - counts + 0.5) / (counts + 0.5))
    shard = search.Shard(row, weights, 2.0, 1.2, 0.75)
    place, score, scored = shard.search(search.np.searchsorted(terms, search.term_counts("common rare")[0]), 2)
    assert sorted(place.tolist()) == [5, 700] and scored < shard.blocks and len(terms) == 9


def test_queries_scored_together(monkeypatch):
    """Whole lists by products of matrices and by lists give plain sums, whatever number of queries meets at once."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    docs = [search.term_counts(" ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 80)))) for _ in range(700)]
    row = search._shard(0, list(range(700)), docs).to_pylist()[0]
    terms = search.np.frombuffer(row["terms"], "<u8")
    shard = search.Shard(row, search.np.linspace(0.1, 7, len(terms)), 40.0, 1.2, 0.75)
    asked = [search.np.sort(search.np.searchsorted(terms, d[0])) for d in docs[:90]] + [search.np.empty(0, search.np.int64)]
    for cells, sparse in ((1 << 22, 64), (700 * 20, 64), (1 << 22, 1), (700, 10**9)):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "SPARSE", sparse)
        whole = list(shard._whole(asked))
        for at, got, (place, score, _) in zip(asked, whole, shard.search_all(asked, 10), strict=True):
            plain = [0] * 700
            for t in at.tolist():
                for p in range(shard.starts[t], shard.starts[t + 1]):
                    plain[shard.docs[p]] += int(shard.impacts[p])
            assert got.tolist() == plain
            best = sorted((-x, i) for i, x in enumerate(plain) if x)[:10]
            assert list(zip((-score).astype(int).tolist(), place.tolist())) == best


def test_later_shards_return_only_what_reaches_the_best_so_far(monkeypatch):
    """Queries that bring a score get from a shard the documents that reach it, equal ones too, and no others."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.randint(1, 60))) for _ in range(500)]
    texts += texts[:40]
    row = search._shard(0, list(range(540)), [search.term_counts(t) for t in texts]).to_pylist()[0]
    terms = search.np.frombuffer(row["terms"], "<u8")
    shard = search.Shard(row, search.np.linspace(7, 0.1, len(terms)), 30.0, 1.2, 0.75)
    every = [search.np.sort(search.np.searchsorted(terms, search.term_counts(t)[0])) for t in texts[:80]]
    for cells, dense in ((1 << 22, 24), (540 * 6, 2), (1 << 22, 10**9)):
        monkeypatch.setattr(search, "CELLS", cells)
        monkeypatch.setattr(search, "DENSE", dense)
        shard.__dict__.pop("table", None)
        whole = [(place.tolist(), score.tolist()) for place, score, _ in shard.search_all(every, 10)]
        for rank in (0, 4, 9):
            least = search.np.array([score[min(rank, len(score) - 1)] for _, score in whole])
            got = {i: (place.tolist(), score.tolist()) for i, place, score in shard.reaching(every, 10, least)}
            for i, (place, score) in enumerate(whole):
                assert got[i] == ([p for p, x in zip(place, score) if x >= least[i]], [x for x in score if x >= least[i]])
        beyond = search.np.array([score[0] + 1 for _, score in whole])
        assert not sum(len(place) for _, place, _ in shard.reaching(every, 10, beyond))


def test_waves_of_shards(spark):
    """Each shard is in one wave, and the best of all waves are the best of all documents."""
    for n in (0, 1, 2, 3, 30, 65):
        waves = search._waves(list(range(0, 7 * n, 7)))
        assert len(waves) == n and sorted(set(waves)) == list(range(max(waves, default=-1) + 1)) and waves.count(0) <= 3
    rng = random.Random(10)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.randint(0, 12)))) for i in range(240)]
    docs += [(i + 240, t) for i, t in docs[::3]]
    queries = [d for d in docs if d[0] % 20 == 0]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(30)
    got = sorted([tuple(r) for r in top_k(frame, spark.createDataFrame(queries, "query_id long, text string"), k=4).collect()], key=str)
    assert got == expected(docs, queries, 4)


def two_kinds(rng, n):
    """Documents of two vocabularies, some of both and some empty."""
    kinds = [[f"{c}{i}" for i in range(120)] for c in "xy"]
    docs = []
    for i in range(n):
        words = kinds[i % 2] if i % 11 else kinds[0] + kinds[1]
        docs.append((i, " ".join(rng.choices(words, [1 / (j % 120 + 1) for j in range(len(words))], k=rng.randint(0, 90)))))
    return docs


def test_topics_are_searched_apart(spark, monkeypatch):
    """Texts of two vocabularies are in shards and blocks of their own, and every query still meets every document."""
    docs = two_kinds(random.Random(12), 480)
    docs += [(i + 480, t) for i, t in docs[::4]]
    queries = [d for d in docs if d[0] % 5 == 0]
    hashes = [search.term_counts(t)[0] for _, t in queries]
    topics = search.Topics(hashes)
    assert len(topics.weights) == 2
    assert len({topics.of(h) for (i, _), h in zip(queries, hashes) if i < 480 and i % 2 and i % 11 and len(h) > 8}) == 1
    assert search.Topics([]).of(hashes[0]) == 0 == search.Topics(hashes[:1]).of(hashes[0])
    monkeypatch.setattr(search, "SHARD_POSTINGS", 1000)
    monkeypatch.setattr(search, "BLOCK_TERMS", 600)
    monkeypatch.setattr(search, "TASK_TERMS", 900)
    seen = []
    every = search._every_pair
    monkeypatch.setattr(search, "_every_pair", lambda some, blocks, *rest: seen.append((some.collect(), blocks.collect())) or every(some, blocks, *rest))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(12)
    got = sorted([tuple(r) for r in top_k(frame, spark.createDataFrame(queries, "query_id long, text string"), k=5).collect()], key=str)
    assert got == expected(docs, queries, 5)
    met = Counter()
    for some, blocks in seen:
        assert len({r["topic"] for r in some}) <= 1 and len({(r["topic"] == s["topic"]) for r in some for s in blocks}) <= 1
        for shard in some:
            for block in blocks:
                met.update((d, q) for d in search.np.frombuffer(shard["ids"], "<i8").tolist() for q in search.np.frombuffer(block["numbers"], "<i8").tolist())
    assert met == Counter((d, q) for d, _ in docs for q, t in queries if t) and len(seen) > 6


def test_pieces_of_parts_hold_every_posting():
    """Parts of a shard together and then by size have each document once, with its contributions, in the order of ids."""
    docs = two_kinds(random.Random(13), 300)
    order = random.Random(14).sample(range(300), 300)
    parts, held = [], {}
    for own in (order[:120], order[120:121], order[121:]):
        row = search._shard(0, [docs[i][0] for i in own], [search.term_counts(docs[i][1]) for i in own]).to_pylist()[0]
        parts.append(search.Shard(row, search.np.linspace(1, 5, len(row["terms"]) // 8), 40.0, 1.2, 0.75))
    contributions = lambda s: {(int(s.ids[d]), int(t), int(x)) for t, b, e in zip(s.terms, s.starts, s.starts[1:]) for d, x in zip(s.docs[b:e], s.impacts[b:e])}
    held = set().union(*map(contributions, parts))
    search_pieces = search.PIECE_DOCS
    try:
        search.PIECE_DOCS = 100
        whole, *pieces = (search.Shard.stored({n: getattr(p, n).astype(kind).tobytes() for n, kind in search.READY.items()}) for p in search.Shard.pieces(parts))
    finally:
        search.PIECE_DOCS = search_pieces
    assert len(pieces) == 3 and contributions(whole) == held == set().union(*map(contributions, pieces))
    assert whole.ids.tolist() == sorted(whole.ids.tolist()) == sorted(i for p in pieces for i in p.ids.tolist())
    assert all((p.docs[b:e][1:] > p.docs[b:e][:-1]).all() for p in (whole, *pieces) for b, e in zip(p.starts, p.starts[1:]))


def test_lists_of_any_length_are_added(monkeypatch):
    """Lists filled up to the length of their class add what they hold, however many are taken at once."""
    docs = [search.term_counts(t) for _, t in two_kinds(random.Random(15), 400)]
    row = search._shard(0, list(range(400)), docs).to_pylist()[0]
    shard = search.Shard(row, search.np.linspace(1, 5, len(row["terms"]) // 8), 40.0, 1.2, 0.75)
    places = search.np.arange(len(shard.terms))
    for listed in (1, 50, 1 << 15):
        monkeypatch.setattr(search, "LISTED", listed)
        scores = search.np.zeros(800, search.np.float32)
        shard._add_lists(scores, places % 2 * 400, places)
        plain = search.np.zeros(800)
        for t in places.tolist():
            for p in range(shard.starts[t], shard.starts[t + 1]):
                plain[t % 2 * 400 + shard.docs[p]] += shard.impacts[p]
        assert search.np.allclose(scores, plain, rtol=1e-5)
