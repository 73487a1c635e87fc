"""Whitening of embeddings by singular values of the centred rows; their covariance is never formed.

1. *Cleaning.* Vectors with null or non-finite entries go, as do those of another length than most. Entries become integers.
2. *Sums* of each dimension, exact integers, added up over tasks.
3. *Blockwise QR.* A task centres its rows, (n x - S) / n with an exact numerator, and reduces them block by block to one
   upper triangle R. Triangles of tasks are stacked and reduced in rounds of ``FAN_IN``, so that no task and not the driver sees
   more than a bounded number of d x d numbers. R'R / n is the covariance.
4. *Householder bidiagonalisation* R = U B V', *dqds* for the singular values of B, to high relative accuracy, and *twisted
   factorisations* of B'B - s^2 for its vectors; V turns them into the directions. These work on d x d numbers on the driver.
5. *Whitening.* Centred rows are projected on the directions and divided by the root of the eigenvalue s^2 / n. The
   covariance of the result is measured in a pass of its own.

Defined results: vectors that are null, empty, of a length other than the most frequent one (the longer one of a tie), or
with null or non-finite entries are dropped; null ids pass, repeated rows count as often as they are there; directions whose
singular value is zero to working precision have no whitening and are left out, so that equal vectors or a single
one give no rows; for an eigenvalue that repeats, any orthonormal directions of its space; a deviation that a long
cannot hold is null; entries are at most 2 ** 62 of the integers from zero; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumipair.llm.common import ship
from lumipair.shared import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 62
# Rows that a task adds to its triangle at a time, and triangles that a task reduces to one.
BLOCK_ROWS = 4096
FAN_IN = 64
EPS = float(np.finfo(np.float64).eps)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def cleaned(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): integer entries of the vectors that stay."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(F.forall("embedding", entry))
    lengths = whole.groupBy(F.size("embedding").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).limit(1).first()
    scaled = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))
    x = F.transform("embedding", lambda c: (F.floor(scaled(c)) + SHIFT).cast("long"))
    return whole.filter(F.size("embedding") == (most.d if most else 0)).select(F.col("vec_id").cast("long"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    held = batch.column(column)
    return held.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(n, sum of each dimension), exact; Python integers."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for item in items:
            if item.num_rows:
                own = _matrix(item, 0).sum(axis=0)
                n, sums = n + item.num_rows, own if sums is None else sums + own
        if sums is not None:
            yield _batch(["n", "sums"], ([n], pa.int64()), ([sums.tolist()], pa.list_(pa.int64())))

    parts = rows.select("x").mapInArrow(run, "n long, sums array<long>")
    added = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("n").cast("decimal(38, 0)")).alias("n"), F.sum(F.col("s").cast("decimal(38, 0)")).alias("s"))
    found = added.orderBy("i").collect()  # one row for each dimension
    return (int(found[0].n), np.array([int(r.s) for r in found], object)) if found else (0, np.zeros(0, object))


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S: exact, in long integers where they hold it."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _reduced(stack: np.ndarray) -> np.ndarray:
    """The triangle of a stack of rows, with as many rows as columns."""
    d = stack.shape[1]
    if len(stack) < d:
        stack = np.concatenate([stack, np.zeros((d - len(stack), d))])
    return np.linalg.qr(stack, mode="r")


def triangle(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, by QR of blocks and of stacks of triangles."""
    d = len(sums)

    def local(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for item in items:
            for begin in range(0, item.num_rows, BLOCK_ROWS):
                own = (_numerators(_matrix(item.slice(begin, BLOCK_ROWS), 0), n, sums) / n).astype(np.float64)
                held = _reduced(own if held is None else np.concatenate([held, own]))
        if held is not None:
            yield _batch(["r"], ([held.ravel().tolist()], pa.list_(pa.float64())))

    def joined(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for item in items:
            for i in range(item.num_rows):
                own = _matrix(item.slice(i, 1), 0).reshape(d, d)
                held = own if held is None else _reduced(np.concatenate([held, own]))
        if held is not None:
            yield _batch(["r"], ([held.ravel().tolist()], pa.list_(pa.float64())))

    found = written(rows.select("x").mapInArrow(local, "r array<double>"), "triangles")
    left = found.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        found = written(found.repartition(left).mapInArrow(joined, "r array<double>"), "triangles")
    stack = [np.array(r.r).reshape(d, d) for r in found.collect()]  # at most FAN_IN triangles
    return _reduced(np.concatenate(stack))


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V) with R = U B V', B upper bidiagonal with diagonal ``a`` and ``b`` above it, by Householder reflections."""
    m, d = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        u = x.copy()
        u[0] += np.copysign(norm, x[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        if (u := reflector(m[k:, k])) is not None:
            m[k:, k:] -= 2 * np.outer(u, u @ m[k:, k:])
        if k < d - 2 and (u := reflector(m[k, k + 1:])) is not None:
            m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ u, u)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _dqds_sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference transform with a shift; None if a pivot would be negative."""
    d, new_q, new_e, least = q[0] - shift, [], [], float("inf")
    for i in range(len(e)):
        if not d >= 0:
            return None
        least = min(least, d)
        total = d + e[i]
        new_q.append(total)
        if total == 0:
            new_e.append(0.0)
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / total
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    if not d >= 0:
        return None
    new_q.append(d)
    return new_q, new_e, min(least, d)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix by dqds, falling."""
    tiny = (10 * EPS) ** 2
    work = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    found: list[float] = []
    while work:
        q, e, sigma = work.pop()
        tries = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q[0] + sigma)
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * (sigma + max(q[i], q[i + 1]))), None)
            if cut is not None:
                if cut < n - 2:
                    work.append((q[:cut + 1], e[:cut], sigma))
                    q, e = q[cut + 1:], e[cut + 1:]
                else:
                    found.append(q[-1] + sigma)
                    q, e = q[:-1], e[:-1]
                continue
            # The smaller eigenvalue of the last two rows, a little less; nothing for the first sweep of a block.
            p, r = q[-2] + e[-1], q[-1]
            gap = (p + r) / 2 - (((p - r) / 2) ** 2 + q[-1] * e[-1]) ** 0.5
            shift = max(0.0, gap * (1 - 8 * EPS)) if tries else 0.0
            swept = _dqds_sweep(q, e, shift)
            while swept is None:
                shift = shift / 4 if shift > tiny * (sigma + q[-1]) else 0.0
                swept = _dqds_sweep(q, e, shift)
            q, e, _ = swept
            sigma += shift
            tries += 1
    return np.array(sorted(found, reverse=True))


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float, rank: int = 0) -> tuple[np.ndarray, float]:
    """(unit vector, residual) of B'B for an eigenvalue by its twisted factorisation at the ``rank``-th smallest pivot."""
    n, small = len(a), EPS * EPS * (value + float(np.max(a * a)))
    guard = lambda x: x if abs(x) > small else (small if x >= 0 else -small)
    diag, low = a * a, b / a[:-1]
    s, p = np.empty(n), np.empty(n)
    plus, minus = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):  # stationary: L D L' - value = L+ D+ L+'
        pivot = guard(diag[i] + s[i])
        plus[i] = low[i] * diag[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    p[n - 1] = diag[n - 1] - value
    for i in range(n - 2, -1, -1):  # progressive: L D L' - value = U- D- U-'
        pivot = guard(diag[i] * low[i] ** 2 + p[i + 1])
        ratio = diag[i] / pivot
        minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    twist = int(np.argsort(np.abs(gamma), kind="stable")[rank])
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -minus[i] * z[i]
    norm = np.linalg.norm(z)
    return z / norm, abs(gamma[twist]) / norm


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling; unit right singular vectors as rows) of the leading directions of R."""
    d = r.shape[1]
    a, b, v = bidiagonal(r)
    size = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((0, d))
    # A diagonal entry of zero has no L D L'; one of rounding size changes no value by more than rounding does. Where an
    # entry above the diagonal has rounding size, B falls into parts; inside a part no value repeats.
    a = np.where(np.abs(a) < EPS * size, EPS * size, a)
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * size) + 1).tolist(), d]
    pairs = []
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        part = squared_singular_values(a[begin:end], b[begin:end - 1])
        pairs += [(value, begin, end) for value in part.tolist()]
    pairs.sort(key=lambda p: (-p[0], p[1]))
    pairs = [p for p in pairs if p[0] > (d * EPS) ** 2 * pairs[0][0]][:components]
    found: list[np.ndarray] = []
    for k, (value, begin, end) in enumerate(pairs):
        # Vectors of close values are kept orthogonal; of the pivots the first that does not give one of the others again.
        close = [z for z, p in zip(found, pairs[:k], strict=True) if p[1] == begin and p[0] - value <= 1e-3 * pairs[0][0]]
        best = np.zeros(d)
        for rank in range(end - begin):
            z = np.zeros(d)
            z[begin:end], _ = twisted_vector(a[begin:end], b[begin:end - 1], value, rank)
            for other in close:
                z -= (other @ z) * other
            if np.linalg.norm(z) > np.linalg.norm(best):
                best = z
            if not close or np.linalg.norm(best) > 0.5:
                break
        best /= np.linalg.norm(best)
        for other in close:
            best -= (other @ best) * other
        found.append(best / np.linalg.norm(best))
    return np.array([p[0] for p in pairs]), np.array(found) @ v.T


@dataclass(frozen=True)
class Whitening:
    """What a table of vectors needs to be whitened: at most d x components numbers."""

    n: int
    sums: np.ndarray
    values: np.ndarray  # eigenvalues of the covariance
    vectors: np.ndarray  # a row for each
    trace: float


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (vec_id, x), None without rows."""
    n, sums = totals(rows)
    if not n:
        return None
    r = triangle(rows, n, sums)
    squared, vectors = directions(r, components)
    return Whitening(n, sums, squared / n, vectors, float((r * r).sum()) / n)


def _whitened(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S, whitened rows)."""
    centred = _numerators(x, w.n, w.sums)
    return centred, (centred / w.n).astype(np.float64) @ w.vectors.T / np.sqrt(w.values)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of the whitened rows minus the identity."""
    k = len(w.values)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k + 1, k + 1))
        for item in items:
            if item.num_rows:
                own = np.column_stack([np.ones(item.num_rows), _whitened(_matrix(item, 0), w)[1]])
                held += own.T @ own
        yield _batch(["g"], ([held.ravel().tolist()], pa.list_(pa.float64())))

    parts = rows.select("x").mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "g"))
    sums = parts.groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").collect()  # (components + 1) ** 2 rows
    gram = np.array([s.g for s in sums]).reshape(k + 1, k + 1)
    mean = gram[0, 1:] / w.n
    return float(np.abs(gram[1:, 1:] / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None where a long cannot hold them."""
    if centred.dtype != object and centred.shape[1] * float(np.abs(centred).max(initial=0)) ** 2 < 2.0 ** 62:
        return (centred * centred).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < 1 << 63 else None for s in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector that stays and direction: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship(spark)
    rows = written(cleaned(vectors), "whitening-rows")
    w = fit(rows, components)
    if w is None or not len(w.values):
        return spark.createDataFrame([], SCHEMA)
    error, k = identity_error(rows, w), len(w.values)
    explained = w.values / w.trace

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item in items:
            for begin in range(0, item.num_rows, BLOCK_ROWS):
                part = item.slice(begin, BLOCK_ROWS)
                m = part.num_rows
                centred, white = _whitened(_matrix(part, 1), w)
                each = np.repeat(np.arange(m), k)
                yield _batch(
                    [c.split()[0] for c in SCHEMA.split(", ")],
                    (part.column(0).take(pa.array(each)), pa.int64()), (np.tile(np.arange(1, k + 1), m), pa.int32()),
                    (np.full(m * k, w.n), pa.int64()), (pa.array(_deviation(centred), pa.int64()).take(pa.array(each)), pa.int64()),
                    (white.ravel(), pa.float64()), (np.tile(explained, m), pa.float64()), (np.full(m * k, error), pa.float64()),
                )

    return rows.mapInArrow(run, SCHEMA)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
