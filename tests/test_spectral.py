"""Spectral coarsening against published values and algebraic identities."""

import dataclasses

import numpy as np
import pytest

from meshgrain.operators import algebra, hierarchy, spectral

TINY = [(0, 0, 1), (1, 0, 2), (2, 1, 2), (3, 2, 3), (4, 3, 4), (5, 3, 5), (6, 4, 5)]
#: Vertex solutions of the tiny graph for right-hand sides of ones, by (weighted, with W).
SOLUTIONS = {
    (False, False): [4.16666666666667, 2.16666666666667, 1.16666666666667, -1.83333333333333, -2.83333333333333, -2.83333333333333],
    (True, False): [1.84483857264231, 0.299384027187765, 0.117565845369583, -0.632434154630417, -0.819350042480884, -0.810004248088361],
    (False, True): [-0.636443964459280, -0.509155171567424, -0.400176721810417, -0.255461194835796, -0.205439104609494, -0.182612537430661],
    (True, True): [-0.546521374685666, -0.443419949706622, -0.371332774518022, -0.258172673931266, -0.223976847914538, -0.216677577841545],
}


def tiny(spark, weighted):
    return spark.createDataFrame([(e, a, b, float(e + 1) if weighted else 1.0) for e, a, b in TINY], "edge long, v0 long, v1 long, w double")


def vertices(spark, n):
    return spark.range(n).withColumnRenamed("id", "vertex")


def dense(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


@pytest.mark.parametrize("weighted,with_w", list(SOLUTIONS))
def test_tiny_solutions(spark, weighted, with_w):
    w = spark.createDataFrame([(i, i, float(i + 1)) for i in range(6)], "i long, j long, v double") if with_w else None
    system = spectral.fine_system(tiny(spark, weighted), vertices(spark, 6), w)
    f = spark.createDataFrame([(i, 1.0 if i or with_w else -5.0) for i in range(6)], "i long, v double")
    for solver in (hierarchy.solve, hierarchy.conjugate_gradients):
        u = {r.i: r.v for r in solver(system, f)[1].collect()}
        assert np.allclose([u[i] for i in range(6)], SOLUTIONS[weighted, with_w], atol=1e-8)


@pytest.mark.parametrize("diagonal,with_w", [(True, False), (True, True), (False, False), (False, True)])
def test_both_solvers_agree(spark, monkeypatch, diagonal, with_w):
    """The same call has the same flux and potential on both sides of LOCAL_DOFS, with g, and f without its zeros."""
    w = spark.createDataFrame([(i, i, float(i + 1)) for i in range(6)], "i long, j long, v double") if with_w else None
    system = spectral.fine_system(tiny(spark, True), vertices(spark, 6), w)
    if not diagonal:
        more = spark.createDataFrame([(i, j, 0.02) for i in range(6) for j in (i, i + 1)] + [(i + 1, i, 0.02) for i in range(6)], "i long, j long, v double")
        system = dataclasses.replace(system, m=algebra.combine((1.0, system.m), (1.0, more)))
    f = spark.createDataFrame([(0, 1.0), (3, -1.0)], "i long, v double")
    g = spark.createDataFrame([(e, 0.5 * e - 1) for e in range(1, 7)], "i long, v double")
    near = hierarchy.solve(system, f, g)
    monkeypatch.setattr(hierarchy, "LOCAL_DOFS", 0)
    for a, b in zip(near, hierarchy.solve(system, f, g)):
        x, y = ({r.i: r.v for r in t.collect()} for t in (a, b))
        assert x.keys() == y.keys() and all(abs(x[i] - y[i]) < 1e-7 for i in x)
    solver = hierarchy.conjugate_gradients if diagonal else hierarchy.minimal_residuals
    with pytest.raises(RuntimeError, match="after 1 iterations"):
        solver(system, f, g, most=1)


def test_tiny_two_levels(spark):
    edges = tiny(spark, True)
    part = spark.createDataFrame([(v, v // 3) for v in range(6)], "vertex long, agg long")
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, vertices(spark, 6)), [part])
    e = h.errors(1, hierarchy.fiedler(edges))
    # fixed values
    assert abs(e["vertex"] - 0.31217311873637132) < 1e-10
    assert abs(e["edge"] - 0.14767829457535478) < 1e-10
    assert abs(e["div"] - 0.3033520464019937) < 1e-10
    assert abs(e["complexity"] - 1.1666666666666667) < 1e-12


def test_identities_on_a_grid(spark):
    """Q P = 1, P_u P_u^T D = D P Q, and the coarse D's pattern, on a weighted grid with several vectors and traces."""
    n = 6
    rng = np.random.default_rng(0)
    pairs = [(r * n + c, r * n + c + s) for r in range(n) for c in range(n) for s in (1, n) if (s == 1 and c < n - 1) or (s == n and r < n - 1)]
    edges = spark.createDataFrame([(k, a, b, float(w)) for k, ((a, b), w) in enumerate(zip(pairs, rng.uniform(1, 5, len(pairs))))], "edge long, v0 long, v1 long, w double")
    part = spark.createDataFrame([(v, (v // n // 3) * 2 + v % n // 3) for v in range(n * n)], "vertex long, agg long")
    par = spectral.Parameters(spectral_tolerance=1.0, max_vectors=4, max_traces=3)
    fine = spectral.fine_system(edges, vertices(spark, n * n))
    c = spectral.coarsen(fine, part, par)
    ne, cv, ce = len(pairs), c.coarse.vdofs.count(), c.coarse.edofs.count()
    assert cv == 16 and ce == 12 + 12
    d, p, u, q = dense(fine.d, n * n, ne), dense(c.s, ne, ce), dense(c.u, n * n, cv), dense(c.q, ce, ne)
    assert np.allclose(q @ p, np.eye(ce), atol=1e-9)
    assert np.allclose(u @ u.T @ d, d @ p @ q, atol=1e-9)
    assert np.allclose(u.T @ u, np.eye(cv), atol=1e-12)
    cd = dense(c.coarse.d, cv, ce)
    assert np.allclose(cd, u.T @ d @ p, atol=1e-9)
    assert (np.abs(cd[:, 12:]) > 1e-9).sum() == 12 and (np.abs(cd[:, :12]) > 1e-9).sum() == 8
    assert np.allclose(dense(c.coarse.m, ce, ce), p.T @ dense(fine.m, ne, ne) @ p)


def test_three_level_path(spark):
    n = 64
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(n - 1)], "edge long, v0 long, v1 long, w double")
    parts = [spark.createDataFrame([(v, v // 2) for v in range(m)], "vertex long, agg long") for m in (64, 32)]
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, vertices(spark, n)), parts, spectral.Parameters(max_vectors=1, max_traces=1))
    f = spark.createDataFrame([(i, -1.0 if i < n // 2 else 1.0) for i in range(n)], "i long, v double")
    assert h.errors(1, f)["vertex"] <= 2 / n
    assert h.errors(2, f)["vertex"] <= 8 / n


def test_power_iteration(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0)], "i long, j long, v double")
    x = spark.createDataFrame([(0, 1.0), (1, 0.3)], "i long, v double")
    value, _ = algebra.power_iterate(a, x, 12, 1e-6)
    assert abs(abs(value) - 3) < 1e-3
