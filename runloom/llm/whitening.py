"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Rows are read three times by tasks that keep one sum each: sums of entries, the centred scatter, and the
covariance of what was whitened. What reaches the driver has the size of one scatter matrix, whatever the
number of rows; there it is factorised. ``V = G G'`` with ``G`` the pivoted triangular factor; rotations of its
columns from the right leave ``G G'`` as it is, and once the columns are orthogonal their squared norms are the
eigenvalues and their directions the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned at most, and rows of an output batch.
COMPONENTS, OUT_ROWS = 32, 1024
#: Entries of which the fixed-point value leaves a long have no place in it.
LARGEST = float(1 << 56)

EPS = float(np.finfo(np.float64).eps)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``g`` of full column rank with ``g @ g.T`` equal to ``v``: a lower triangle with its rows put back in place.

    The largest remaining diagonal entry is the next pivot; it ends where that is lost in the rounding of ``v``.
    """
    d = len(v)
    left = np.diag(v).astype(np.float64).copy()
    g = np.zeros((d, d))
    least = d * EPS * max(left.max(initial=0.0), 0.0)
    done = np.zeros(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(done, -1.0, left)))
        if done[p] or left[p] <= least:
            return g[:, :k]
        column = v[:, p] - g[:, :k] @ g[p, :k]
        column[done] = 0.0
        g[:, k] = column / math.sqrt(left[p])
        g[p, k] = math.sqrt(left[p])
        left -= g[:, k] ** 2
        done[p] = True
    return g


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs, as in a tournament."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if max(a, b) < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``g`` with its columns rotated pairwise until all are orthogonal to double precision."""
    g = g.copy()
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(g.shape[1]):
            a, b = g[:, p], g[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > 4 * EPS * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            a, b, p, q = a[:, turn], b[:, turn], p[turn], q[turn]
            zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            return g
    raise RuntimeError(f"columns are not orthogonal after {sweeps} sweeps")


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a covariance, as many as it has rank."""
    g = one_sided_jacobi(pivoted_cholesky(v))
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > len(v) * EPS * values.max(initial=0.0)]
    return values[order], g[:, order] / np.sqrt(values[order])


def _matrices(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, fixed-point entries) of the vectors of a batch, by their length."""
    column = b.column(at)
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = flat[offsets[rows][:, None] + np.arange(d)]
        yield d, rows, np.floor(SCALE * x).astype(np.int64) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they hold it, else in Python integers."""
    if max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums))) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(x, n, sums).astype(np.float64) / n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for b in batches:
        for d, rows, x in _matrices(b, 0):
            own = found.setdefault(d, [0, [0] * d])
            own[0] += len(rows)
            exact = x if int(np.abs(x).max()) * len(rows) < 1 << 62 else x.astype(object)
            own[1] = [a + int(s) for a, s in zip(own[1], exact.sum(0))]
    for d, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))],
            names=["dim", "i", "n", "s"],
        )


def _products(rows_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Upper triangles of the summed products of the columns that ``rows_of`` makes of a vector, and of one more: 1."""
    found: dict[int, np.ndarray] = {}
    for b in batches:
        for d, _, x in _matrices(b, 0):
            z = rows_of(d, x)
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            found[d] = found.get(d, 0) + z.T @ z
    for d, m in found.items():
        for i, row in enumerate(m):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row[i:]], pa.list_(pa.float64()))], names=["dim", "i", "row"]
            )


def _summed(vectors: DataFrame, rows_of) -> dict[int, np.ndarray]:
    """The products of all rows, by length: (columns + 1) squared numbers each."""
    cells = vectors.mapInArrow(lambda batches: _products(rows_of, batches), "dim int, i int, row array<double>").select("dim", "i", F.posexplode("row").alias("j", "x"))
    out: dict[int, dict] = {}
    for r in cells.groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r.dim, {})[r.i, r.i + r.j] = r.x
    found = {}
    for d, cells in out.items():
        m = np.zeros((max(i for i, _ in cells) + 1,) * 2)
        for (i, j), x in cells.items():
            m[i, j] = m[j, i] = x
        found[d] = m
    return found


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Per usable row and component, up to ``count``: ``id, component, n, deviation, whitened, explained, identity_error``.

    An entry c stands as ``x = floor(64 c) + 1000000``. All usable vectors of one length are fitted together: ``n`` of
    them, with sums S and a covariance of divisor n, centred first. ``component`` counts from 1 by falling eigenvalue
    e; ``whitened`` is ``x - S / n`` on the component over ``sqrt(e)``, ``explained`` e over the trace,
    ``deviation`` the exact ``sum((n x - S)^2)`` (null where a long can't hold it) and ``identity_error`` the largest
    entry by which the covariance of ``whitened``, summed over all rows once more, differs from the identity.

    Rows whose vector is null or holds null or non-finite entries, or entries of 2^56 and beyond, are left out. There
    are as many components as the covariance has rank: vectors that are all alike, a single vector and empty
    vectors give no row. Repeated rows count and come back as often as they occur, rows without an id too. The
    driver holds one square matrix per length of vectors.
    """
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(good)
    alone = rows.select("v")

    sums: dict[int, list[int]] = {}
    n: dict[int, int] = {}
    counted = alone.mapInArrow(_sums, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    for r in sorted(counted.collect(), key=lambda r: (r.dim, r.i)):
        n[r.dim] = r.n
        sums.setdefault(r.dim, []).append(int(r.s))

    scatter = _summed(alone, lambda d, x: _centred(x, n[d], sums[d]))
    fitted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d, m in scatter.items():
        v = m[:d, :d] / n[d]
        values, units = components(v)
        k = min(count, len(values))
        if k:
            fitted[d] = (units[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v))

    white = lambda d, x: _centred(x, n[d], sums[d]) @ fitted[d][0] if d in fitted else np.zeros((len(x), 0))
    error: dict[int, float] = {}
    for d, m in _summed(alone, white).items():
        mean = m[:-1, -1] / n[d]
        error[d] = float(np.abs(m[:-1, :-1] / n[d] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                b = pa.RecordBatch.from_arrays([c.take(pa.array(range(at, min(at + OUT_ROWS, whole.num_rows)))) for c in whole.columns], names=whole.schema.names)
                for d, own, x in _matrices(b, 1):
                    if d not in fitted:
                        continue
                    w, explained = fitted[d]
                    k = w.shape[1]
                    off = _deviations(x, n[d], sums[d])
                    exact = off if off.dtype != object and d * float(np.abs(off).max()) ** 2 < 1 << 62 else off.astype(object)
                    deviation = [s if s < 1 << 63 else None for s in (exact * exact).sum(1).tolist()]
                    ids = b.column(0).take(pa.array(np.repeat(own, k)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                            pa.array(np.full(len(ids), n[d], np.int64)),
                            pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), k))),
                            pa.array(white(d, x).ravel()),
                            pa.array(np.tile(explained, len(own))),
                            pa.array(np.full(len(ids), error[d])),
                        ],
                        names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
