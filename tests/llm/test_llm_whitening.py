"""Whitening against numpy's dense eigenvectors, and its edge cases."""

import math

import duckdb
import numpy as np
import pytest

from ledgerlens.llm.jacobi_davidson import EPS, largest_eigenpairs, minres
from ledgerlens.llm.whitening import op11_whitening, whitened

SF = "/root/testdata/sf0.001"


def brute(rows, components=4):
    """{(row, component): (vec_id, n, deviation, |whitened|, explained)}"""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array([s / n for s in sums])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(min(components, len(sums))):
            if e[k] > 1e-9 * e[0]:
                z = float((np.array(x) - np.array(sums) / n) @ u[:, k]) / math.sqrt(e[k])
                out.append((i, k + 1, n, dev, abs(z), e[k] / e.sum()))
    return out


def check(got, rows):
    expected = sorted(brute(rows), key=str)
    found = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=str)
    key = lambda r: (str(r[0]), r[1], r[3], r[4])
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], abs=1e-8) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-9 for r in got)


def test_whole_table_against_dense_eigenvectors(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    got = op11_whitening(spark, SF).collect()
    check(got, rows)
    # One sign per component for all rows: whitened columns are uncorrelated.
    z = np.zeros((len(rows), 4))
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        z[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(z.T @ z / len(z) - np.eye(4)).max() < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    rows += [(None, rows[0][1]), (3, rows[5][1]), (7, None), (8, [0.1] * 5 + [None]), (9, [math.nan] * 6),
             (10, [0.0] * 5 + [math.inf]), (11, [-0.001, 0.0, 1e3, -1e3, 0.5, 2.0])]
    got = whitened(frame(spark, rows)).collect()
    check(got, rows)
    # Vectors of another length and empty ones take no part.
    assert len(whitened(frame(spark, [*rows, (50, [1.0, 2.0]), (51, [])])).collect()) == len(got)


def test_few_components(spark):
    two = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0])]
    check(whitened(frame(spark, two)).collect(), two)
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(5)]  # one direction only
    got = whitened(frame(spark, line)).collect()
    assert {r.component for r in got} == {1}
    check(got, line)
    assert whitened(frame(spark, [(1, [0.5, 0.5])])).collect() == []  # no variance
    assert whitened(frame(spark, [])).collect() == []


def test_exact_deviation_and_its_limit(spark):
    rows = [(1, [4e9, 0.0]), (2, [-4e9, 1.0]), (3, [0.25, 3.0])]
    got = {r.vec_id: r.deviation for r in whitened(frame(spark, rows)).collect()}
    exact = {i: d for i, _, _, d, _, _ in brute(rows)}
    assert got == {i: (d if d < 1 << 63 else None) for i, d in exact.items()}
    assert None in got.values() and any(got.values())


def test_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(20)]
    wide = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, x long, n string, component int")
    check(whitened(wide).collect(), rows)


@pytest.mark.parametrize("d, wanted", [(1, 4), (3, 4), (30, 4), (120, 5)])
def test_eigenpairs_to_double_precision(d, wanted):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((3 * d, d))
    a = a.T @ a
    values, vectors, worst = largest_eigenpairs(lambda v: a @ v, d, wanted)
    exact = np.linalg.eigvalsh(a)[::-1][:wanted]
    assert np.abs(values - exact).max() < 1e-13 * exact[0]
    assert worst <= 32 * EPS and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_equal_eigenvalues():
    a = np.diag([5.0, 5, 5, 2, 1] + [0.5] * 80)
    values, vectors, _ = largest_eigenpairs(lambda v: a @ v, len(a), 4)
    assert values == pytest.approx([5, 5, 5, 2], rel=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    q = np.linalg.qr(rng.standard_normal((20, 2)))[0]
    right = rng.standard_normal((20, 1))
    right -= q @ (q.T @ right)
    x = minres(lambda v: a @ v, right, np.array([0.3]), [q], 40, 1e-13)
    left = a @ x - 0.3 * x
    assert np.abs(left - q @ (q.T @ left) - right).max() < 1e-8
