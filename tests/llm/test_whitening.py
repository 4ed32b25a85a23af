"""Whitening against numpy's decomposition of the whole covariance."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pytest

from runloom.llm import whitening


def vectors_frame(spark, rows):
    """Rows with columns that clash with names used inside."""
    return spark.createDataFrame([(i, v, "x", k, 0.5) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, v string, n long, whitened double")


def plain(rows, count=32):
    """{id: [(component, n, deviation, |whitened|, explained)]} of vectors of one length."""
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    z = (n * x - s).astype(float) / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(count, int((e > e[0] * 1e-12).sum()))
    w = z @ u[:, :k] / np.sqrt(e[:k])
    dev = ((n * x - s) ** 2).sum(1)
    return [[(i + 1, n, int(d), abs(w[r, i]), e[i] / np.trace(cov)) for i in range(k)] for r, d in enumerate(dev)]


def got_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((r.component, r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error <= 1e-9
    return {k: sorted(v) for k, v in out.items()}


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3]
        assert a[3:] == pytest.approx(b[3:], rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("dims, rank", [(6, 6), (40, 40), (10, 3)])
def test_against_numpy(spark, dims, rank):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((300, rank)) * np.arange(1, rank + 1) @ rng.standard_normal((rank, dims)) + 3
    if rank < dims:  # whole multiples of 1/64 keep their rank
        x = (rng.integers(-50, 50, (300, rank)) @ rng.integers(-3, 4, (rank, dims))) / 64
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = got_of(whitening.whiten(vectors_frame(spark, rows).repartition(5)))
    for (i, _), want in zip(rows, plain(rows)):
        same(got[i], want)
    assert {len(v) for v in got.values()} == {min(rank, 32)}


def test_rows_that_are_left_out_and_repeated(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(30)]
    good += [(7, good[3][1]), (None, good[4][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]), (105, [1e300, 0.0, 0.0, 0.0, 0.0])]
    got = got_of(whitening.whiten(vectors_frame(spark, good + bad)))
    want = plain(good)
    assert set(got) == {*range(30), None}
    same(got[0], want[0])
    same(got[None], want[31])
    assert len(got[7]) == 10 and {r[1] for r in got[7]} == {32}


def test_lengths_are_fitted_on_their_own(spark):
    rng = np.random.default_rng(2)
    a = [(i, rng.standard_normal(4).tolist()) for i in range(20)]
    b = [(100 + i, rng.standard_normal(3).tolist()) for i in range(25)]
    got = got_of(whitening.whiten(vectors_frame(spark, a + b)))
    same(got[5], plain(a)[5])
    same(got[100], plain(b)[0])


def test_no_spread_gives_no_component(spark):
    assert whitening.whiten(vectors_frame(spark, [])).count() == 0
    assert whitening.whiten(vectors_frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors_frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0


def test_large_entries_are_exact(spark):
    big = float(1 << 52)
    rows = [(1, [big, 0.0]), (2, [-big, 1.0]), (3, [0.5, 4.0])]
    got = whitening.whiten(vectors_frame(spark, rows)).where("component = 1").orderBy("id").collect()
    assert [r.deviation for r in got] == [None, None, 64**2 + 448**2]  # beyond a long; in the middle
    small = whitening.whiten(vectors_frame(spark, [(1, [2.0**24, 0.0]), (2, [-(2.0**24), 1.0])])).where("component = 1").orderBy("id").collect()
    assert [r.deviation for r in small] == [(2**31) ** 2 + 64**2] * 2


def test_components_of_hard_matrices():
    rng = np.random.default_rng(4)
    for d, rank in [(1, 1), (7, 7), (8, 8), (30, 11)]:
        g = rng.standard_normal((d, rank)) * np.exp(-2.0 * np.arange(rank))
        v = g @ g.T
        values, units = whitening.components(v)
        assert (np.diff(values) <= 0).all() and np.abs(units.T @ units - np.eye(len(values))).max() < 1e-13
        assert np.abs(units * values @ units.T - v).max() < 1e-13 * values[0]
    equal, units = whitening.components(np.eye(6) * 3)
    assert np.allclose(equal, 3) and np.allclose(np.abs(units).sum(0), 1)
    assert len(whitening.components(np.zeros((4, 4)))[0]) == 0


def test_sums_in_tasks_do_not_overflow():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([[2.0**55]] * 10)], names=["v"])
    out = list(whitening._sums(iter([b])))[0]
    assert out.column(3).to_pylist() == [Decimal(10 * (2**61 + 1000000))]
