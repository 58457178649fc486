"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Vectors become whole numbers, so that sums and centred products are exact, however many rows there are. The scatter
matrix has one entry for each pair of dimensions; from there on everything is as small as that matrix:

* its characteristic polynomial modulo many primes, by Hessenberg reduction, one Spark row for each prime;
* the integer polynomial by Chinese remaindering;
* its roots, all real, by bisection between numbers with finitely many binary digits: the sign changes in the
  coefficients of ``q(t + x)`` are exactly the number of roots beyond ``t``, with their multiplicities;
* a component for each root by inverse iteration in decimal arithmetic, one Spark row for each component; roots that
  cannot be told apart share a null space, from which an orthonormal basis is taken.

Rows are whitened in one narrow pass, and a pass before it measures the covariance of what that pass returns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, pack, ship_package

OFFSET = 1_000_000  # added to every whole component, by the contract of the operator
MOST = float(2**53)  # larger components fail the job
BITS = 256  # binary digits of a root after the point
DIGITS = 160  # decimal digits of inverse iteration


def exact_products(z: np.ndarray) -> np.ndarray:
    """``z' z`` of whole numbers, exact: in floating point or 64 bits where the sums fit, else in Python's integers."""
    largest = int(np.abs(z).max(initial=0))
    total = largest * largest * len(z)
    if total < 2**53:
        return (z.T.astype(float) @ z.astype(float)).astype(np.int64).astype(object)
    if total < 2**63:
        return (z.T @ z).astype(object)
    wide = z.astype(object)
    return wide.T @ wide


def charpoly_modulo(matrix: list[list[int]], prime: int) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial modulo a prime below 2**31."""
    h = np.array([[v % prime for v in row] for row in matrix], np.int64)
    size = len(h)
    for m in range(1, size - 1):
        nonzero = np.flatnonzero(h[m:, m - 1])
        if not len(nonzero):
            continue
        pivot = m + int(nonzero[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, prime) % prime
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m]) % prime
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % prime).sum(axis=1)) % prime
    polys = np.zeros((size + 1, size + 1), np.int64)  # of the leading blocks
    polys[0, 0] = 1
    for m in range(1, size + 1):
        poly = -int(h[m - 1, m - 1]) * polys[m - 1] % prime
        poly[1:] += polys[m - 1, :-1]
        below = 1
        for i in range(1, m):
            below = below * int(h[m - i, m - i - 1]) % prime
            if below == 0:
                break
            poly = (poly - int(h[m - i - 1, m - 1]) * below % prime * polys[m - i - 1]) % prime
        polys[m] = poly % prime
    return polys[size].tolist()


def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(base, odd, n)
        if x in (1, n - 1) or n == base:
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2**31, so many that their product exceeds the bound."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def chinese(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The smallest integers in absolute value with the given residues."""
    values, modulus = [0] * len(residues[0][1]), 1
    for prime, own in residues:
        inverse = pow(modulus, -1, prime)
        values = [v + modulus * ((r - v) * inverse % prime) for v, r in zip(values, own)]
        modulus *= prime
    return [v - modulus if 2 * v > modulus else v for v in values]


def roots_beyond(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only lie beyond ``at``: sign changes of its coefficients there."""
    shifted = list(poly)
    for i in range(len(poly) - 1):
        for j in range(len(poly) - 2, i - 1, -1):
            shifted[j] += at * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value_at(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def isolated_root(poly: list[int], top: int, number: int) -> tuple[int, int, int]:
    """The ``number``-th largest root lies in ``(low, low + 1]``: ``low``, roots beyond that, roots within."""
    low, high = -1, top
    above, beyond = roots_beyond(poly, low), 0
    while high - low > 1:
        if above - beyond == 1:
            break
        mid = (low + high) // 2
        found = roots_beyond(poly, mid)
        if found >= number:
            low, above = mid, found
        else:
            high, beyond = mid, found
    at_high = value_at(poly, high) if high - low > 1 else 0
    if high - low > 1 and at_high == 0:
        return high - 1, beyond, 1
    while high - low > 1:  # a single root: the sign tells on which side of a number it lies
        mid = (low + high) // 2
        value = value_at(poly, mid)
        if value == 0:
            return mid - 1, beyond, 1
        if (value > 0) == (at_high > 0):
            high = mid
        else:
            low = mid
    return low, beyond, above - beyond


def null_space(matrix: list[list[int]], root: int, bits: int, dimensions: int) -> np.ndarray:
    """Unit vectors that span the eigenvectors at ``root / 2**bits``: inverse iteration of a block in decimals."""
    size = len(matrix)
    with localcontext() as context:
        context.prec = DIGITS
        value = Decimal(root) / Decimal(2**bits)
        a = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        for i in range(size):
            a[i, i] -= value
        least = max(abs(v) for v in a.ravel()) * Decimal(10) ** (10 - DIGITS) or Decimal(1)
        # numbers without pattern to start from, the same on every machine
        start = [[Decimal((7919 * (i + 1) * (k + 3) * (k + i + 11)) % 2003 + 1) for k in range(dimensions)] for i in range(size)]
        block = np.array(start, dtype=object)
        order = list(range(size))
        for k in range(size):
            pivot = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < least:
                a[k, k] = least
            factors = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(factors, a[k, k + 1 :])
            a[k + 1 :, k] = factors
        for _ in range(3):
            solved = block[order]
            for k in range(size):
                solved[k + 1 :] -= np.outer(a[k + 1 :, k], solved[k])
            for k in range(size - 1, -1, -1):
                solved[k] = (solved[k] - a[k, k + 1 :] @ solved[k + 1 :]) / a[k, k] if k + 1 < size else solved[k] / a[k, k]
            for k in range(dimensions):
                column = solved[:, k] / max(abs(v) for v in solved[:, k])
                for _ in range(2):
                    for other in range(k):
                        column = column - solved[:, other] * (solved[:, other] @ column)
                solved[:, k] = column / (column @ column).sqrt()
            block = solved
        return block


def exact_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """The characteristic polynomial of a non-negative definite integer matrix, constant first."""
    size, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # elementary symmetric functions of non-negative roots are largest when all are equal
    bound = 2 * max(math.comb(size, k) * (trace // size + 1) ** k for k in range(size + 1)) + 1
    primes = primes_beyond(bound)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            if own:
                residues = pa.array([charpoly_modulo(matrix, p) for p in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), residues], ["prime", "residues"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    return chinese([(r["prime"], r["residues"]) for r in rows.mapInArrow(work, "prime long, residues array<long>").collect()])


def principal_components(spark, matrix: list[list[int]], most: int) -> list[tuple[float, float, np.ndarray]]:
    """``(root as double, share of the trace, unit vector)`` of the largest positive roots, falling."""
    size, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    if trace == 0:
        return []
    poly = exact_polynomial(spark, matrix)
    scaled = [c << (BITS * (size - i)) for i, c in enumerate(poly)]  # roots times 2**BITS
    positive = roots_beyond(scaled, 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number in batch.column(0).to_pylist():
                low, beyond, together = isolated_root(scaled, trace << BITS, number)
                vector = null_space(matrix, low + 1, BITS, together)[:, number - 1 - beyond]
                with localcontext() as context:
                    context.prec = DIGITS
                    root = Decimal(low + 1) / Decimal(2**BITS)
                    out.append((number, float(root), float(root / Decimal(trace)), [float(v) for v in vector]))
            if out:
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["component", "root", "share", "vector"])

    wanted = min(most, positive)
    tasks = max(1, min(wanted, spark.sparkContext.defaultParallelism))
    rows = spark.range(1, wanted + 1, numPartitions=tasks).select(F.col("id").cast("int").alias("component"))
    found = rows.mapInArrow(work, "component int, root double, share double, vector array<double>").collect()
    return [(r["root"], r["share"], np.array(r["vector"])) for r in sorted(found, key=lambda r: r["component"])]


def _sums(rows: DataFrame, per_batch: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[tuple[int, int], object]:
    """Sums over all rows of a small matrix made from each batch, added up in each task before the shuffle."""
    whole = kind.startswith("decimal")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = per_batch(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape, dtype=np.int32)
            flat = total.ravel().tolist()
            values = pa.array([Decimal(int(v)) for v in flat], pa.decimal128(38, 0)) if whole else pa.array(flat, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), values], ["i", "j", "value"])

    sums = rows.select("x").mapInArrow(work, f"i int, j int, value {kind}").groupBy("i", "j").agg(F.sum("value").alias("value"))
    return {(r["i"], r["j"]): r["value"] for r in sums.collect()}


def _whole(sums: dict[tuple[int, int], object], shape: tuple[int, int]) -> list[list[int]]:
    return [[int(sums[i, j]) for j in range(shape[1])] for i in range(shape[0])]


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, x`` of the vectors that take part, stored once; see ``whiten``."""
    rows = pack(vectors, id=id_col, vector=vector_col)
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = rows.where(F.coalesce((F.size("vector") > 0) & finite, F.lit(False)))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = widths.orderBy(F.col("n").desc(), F.col("width").desc()).first()
    rows = rows.where(F.size("vector") == (0 if common is None else common["width"]))
    scaled = F.transform("vector", lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    far = F.exists("vector", lambda c: F.abs(c.cast("double")) * F.lit(float(scale)) > F.lit(MOST))
    scaled = F.when(far, F.raise_error(F.lit("a component is too large")).cast("array<long>")).otherwise(scaled)
    return materialize(rows.select("id", F.transform(scaled, lambda c: c + F.lit(OFFSET)).alias("x")), "whole-vectors")


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    most: int = 32,
    scale: int = 64,
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Vectors that are null, empty or hold null, NaN or infinite entries have no row, nor have those of another length
    than most (with equal counts the longer length stands). Repeated vectors and ids each count. Components without
    variance are left out: of a single vector, or of equal ones, nothing is returned, nor of an empty table. A
    ``deviation`` beyond a long is null. Components beyond 2**53 fail the job. Other columns are not read.

    The driver holds sums for each pair of dimensions, never rows; tasks hold a batch and such sums.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    kind = rows.schema["id"].dataType.simpleString()
    sums = _sums(rows, lambda x: np.array([[len(x), *x.astype(object).sum(axis=0)]], dtype=object), "decimal(38,0)")
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not sums:
        return empty
    (n, *total) = _whole(sums, (1, len(sums)))[0]
    size = len(total)
    centre = np.array([s // n for s in total], np.int64)  # the rest of the mean follows exactly
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    products = _whole(_sums(rows, lambda x: exact_products(x - centre), "decimal(38,0)"), (size, size))
    scatter = [[n * products[i][j] - rest[i] * rest[j] for j in range(size)] for i in range(size)]  # n^2 V
    common = math.gcd(*(v for row in scatter for v in row)) or 1
    found = principal_components(spark, [[v // common for v in row] for row in scatter], most)
    if not found:
        return empty
    axes = np.column_stack([v / math.sqrt(root * common) * n for root, _, v in found])  # over sqrt(root * common / n^2)
    mean = np.array([r / n for r in rest])

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - mean) @ axes

    def second(x: np.ndarray) -> np.ndarray:
        w = whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    count = len(found)
    seen = _sums(rows, second, "double")
    centred = np.array([[seen[i, j] / n - seen[count, i] / n * seen[count, j] / n for j in range(count)] for i in range(count)])
    error = float(np.abs(centred - np.eye(count)).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                flat = pa.array(np.ravel(whitened(x)))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * count)
                deviation = pa.array(deviations(x - centre, n, rest), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), deviation, pa.ListArray.from_arrays(offsets, flat)], ["id", "deviation", "whitened"])

    out = rows.mapInArrow(work, f"id {kind}, deviation long, whitened array<double>")
    out = out.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(float(share)) for _, share, _ in found])
    return out.select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def deviations(z: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """``sum((n * x - S) ** 2)`` of each row, from whole numbers near the mean; null beyond 63 bits."""
    largest = n * int(np.abs(z).max(initial=0)) + max(map(abs, rest))
    exact = np.int64 if largest * largest * z.shape[1] < 2**63 else object
    off = z.astype(exact) * n - np.array(rest, dtype=exact)
    return [int(v) if v < 2**63 else None for v in (off * off).sum(axis=1)]
