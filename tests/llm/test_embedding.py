from __future__ import annotations

import numpy as np

from ridgeline.llm.embedding import AUDIT_LINKS, Graph, audit, embedding_duplicates, linked

SCHEMA = "vec_id long, label int, embedding array<double>, n_links string, node int"


def expected(rows, limit=0.98):
    unit = []
    for _, label, v in rows:
        fine = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / np.abs(v).max() if fine else None
        unit.append(x / np.linalg.norm(x) if fine else None)
    near = lambda a, b: (
        a != b and unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= limit
    )
    links = [[b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, stack = {a}, [a]
        while stack:
            for b in links[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), low, rows[a][0] is not None and rows[a][0] == low))
    return sorted(out, key=str)


def odd_rows(count=150):
    rng = np.random.default_rng(2)
    strange = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [1e-300] * 8, [1e300] * 8]
    rows = []
    for i in range(count):
        vector = (np.eye(8)[rng.integers(0, 8)] + rng.normal(0, 0.05, 8)).tolist()
        if rows and rng.random() < 0.2:
            vector = rows[rng.integers(0, len(rows))][2]
        if rng.random() < 0.1:
            vector = strange[rng.integers(0, len(strange))]
        rows.append((None if rng.random() < 0.05 else int(rng.integers(0, 120)), None if rng.random() < 0.1 else int(rng.integers(0, 2)), vector))
    return rows


def result(frame, **options):
    return sorted([tuple(r) for r in embedding_duplicates(frame, **options).collect()], key=str)


def test_odd_rows(spark):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert result(frame) == expected(rows)
    assert result(frame, shard_rows=10, block_rows=7) == expected(rows)
    assert result(frame.limit(0)) == []


def test_beams_widen_until_a_dense_group_is_whole():
    rng = np.random.default_rng(3)
    center = rng.normal(size=32)
    vectors = np.concatenate([center + rng.normal(0, 0.02, (700, 32)), rng.normal(size=(1500, 32))])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    node = np.arange(len(unit))
    graph = Graph.unpacked(Graph.build(node, np.ones(len(unit), np.int64), unit).packed())
    query, place, _ = linked(graph, node, unit, 0.98)
    truth = (unit @ unit.T >= 0.98).sum() - len(unit)
    assert truth > 100_000 and len(query) >= 0.99 * truth
    assert (np.einsum("nd,nd->n", unit[query], graph.unit[place]) >= 0.98).all()
    assert (graph.node[place] != node[query]).all()


def test_audits_go_on_until_they_have_seen_links():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(600, 16))
    unit[1::300] = unit[0::300] + 1e-3  # two pairs
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    node = np.arange(600)
    graph = Graph.build(node, np.ones(600, np.int64), unit)
    checked, links = audit(graph, node, unit, 0.98)
    assert sorted(checked) == list(range(600)) and links == 4  # hits of a query on itself do not count
    dense = unit[:1] + rng.normal(0, 0.01, (600, 16))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    checked, links = audit(Graph.build(node, np.ones(600, np.int64), dense), node, dense, 0.98)
    assert len(checked) < 600 and links >= AUDIT_LINKS


def test_links_across_shards_of_thousands(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(12_000, 24))
    vectors[6_000:9_000] = vectors[:3_000] + rng.normal(0, 0.06, (3_000, 24))
    vectors[9_000:9_400] = vectors[0] + rng.normal(0, 0.08, (400, 24))
    frame = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors.tolist())], "vec_id long, label int, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    found = {r.vec_id: r for r in embedding_duplicates(frame, shard_rows=4_000, block_rows=512).collect()}
    links = np.array([found[i].n_links for i in range(12_000)])
    assert near.sum() > 20_000 and (links <= near.sum(axis=1)).all()
    assert links.sum() >= 0.99 * near.sum()
    pairs = [(i, i + 6_000) for i in range(1, 3_000) if near[i, i + 6_000]]
    assert len(pairs) > 1_000
    joined = sum(found[a].component_id == found[b].component_id for a, b in pairs)
    assert joined >= 0.99 * len(pairs)
