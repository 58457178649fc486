from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from ridgeline.llm.queries import op12_embedding_whitening
from ridgeline.llm.whitening import BITS, charpoly_modulo, chinese, exact_products, isolated_root, null_space, primes_beyond, roots_beyond, whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def plain_polynomial(matrix):
    """By exact traces of powers; constant first."""
    a = np.array(matrix, dtype=object)
    size = len(matrix)
    unit = np.array([[int(i == j) for j in range(size)] for i in range(size)], dtype=object)
    out, power = [1], unit * 0
    for k in range(1, size + 1):
        power = a @ power + out[-1] * unit
        out.append(-sum((a @ power)[i, i] for i in range(size)) // k)
    return out[::-1]


def check(rows, got, most=32):
    """All columns against eigenvectors of numpy and fractions."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], float)
    n, size = x.shape
    mean = [Fraction(sum(int(r[1][j]) for r in kept), n) for j in range(size)]
    off = np.array([[float(v - m) for v, m in zip(r[1], mean)] for r in kept])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == n * count
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-6)
        by.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened))
    exact = {i: int(sum((n * (v - m)) ** 2 for v, m in zip(x, mean))) for i, x in kept}
    for k in range(1, count + 1):
        assert all(d == exact[i] for i, d, _ in by[k])
        gap = min(abs(values[k - 1] - v) for j, v in enumerate(values) if j != k - 1)
        if gap > 1e-3 * values[0]:  # else any basis of the shared space will do
            wanted = dict(zip([i for i, _ in kept], off @ vectors[:, k - 1] / math.sqrt(values[k - 1])))
            sign = np.sign(sum(w * wanted[i] for i, _, w in by[k]))
            for i, _, w in by[k]:
                assert w * sign == pytest.approx(wanted[i], abs=1e-8)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 5, "n") for r in rows], SCHEMA).repartition(5)


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * [3, 1, 1, 0.5, 2, 0]).tolist()) for i in range(200)]
    rows = [(i, [*v[:5], v[0]]) for i, v in rows]  # one dimension twice: a root of zero
    rows += [(500 + i, rows[3][1]) for i in range(100)] + [(600, rows[3][1]), (600, rows[3][1])]
    odd = [(900, None), (901, []), (902, [math.nan] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [1.0, math.inf, 0.0, 0.0, 0.0, 0.0])]
    got = whiten(frame_of(spark, [*rows, *odd, (905, [1.0, 2.0])])).collect()
    check(rows, got)
    assert {r.component for r in got} == {1, 2, 3, 4, 5}
    assert {r.component for r in whiten(frame_of(spark, rows), most=2).collect()} == {1, 2}


def test_equal_roots(spark):
    """A cube's corners vary alike in all directions."""
    rows = [(i, [float(i >> j & 1) for j in range(3)]) for i in range(8)]
    got = whiten(frame_of(spark, rows)).collect()
    check(rows, got)
    assert {round(r.explained, 12) for r in got} == {round(1 / 3, 12)}


def test_nothing_to_whiten(spark):
    assert whiten(frame_of(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(frame_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(frame_of(spark, [(1, None)])).count() == 0
    empty = whiten(frame_of(spark, [(1, None)]).limit(0))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.count() == 0


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(rows, op12_embedding_whitening(spark, folder).collect())


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_and_roots(seed):
    rng = np.random.default_rng(seed)
    z = rng.integers(-50, 50, (30, 7))
    z[:, 3] = z[:, 1] if seed % 2 else z[:, 3]
    matrix = exact_products(z).tolist()
    trace = sum(matrix[i][i] for i in range(7))
    poly = chinese([(p, charpoly_modulo(matrix, p)) for p in primes_beyond(2 * (trace + 1) ** 7)])
    assert poly == plain_polynomial(matrix)
    scaled = [c << (BITS * (7 - i)) for i, c in enumerate(poly)]
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    assert roots_beyond(scaled, 0) == (6 if seed % 2 else 7)
    for k in range(1, 7):
        low, beyond, together = isolated_root(scaled, trace << BITS, k)
        assert (beyond, together) == (k - 1, 1)
        assert (low >> BITS) == pytest.approx(values[k - 1], abs=1.5)
        vector = null_space(matrix, low + 1, BITS, 1)[:, 0].astype(float)
        assert np.abs(np.array(matrix, float) @ vector - values[k - 1] * vector).max() <= 1e-8 * values[0]


def test_exact_products_of_any_size():
    for largest in (10, 2**28, 2**45):
        z = np.random.default_rng(0).integers(-largest, largest, (20, 3))
        wide = z.astype(object)
        assert (exact_products(z) == wide.T @ wide).all()
