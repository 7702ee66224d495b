"""Eigenpairs of many groups over tables against dense ones, and spectral coarsening that uses them."""

import numpy as np
import pytest

from meshgrain.operators import eigen, spectral


def grid(n, seed):
    rng = np.random.default_rng(seed)
    pairs = [(r * n + c, r * n + c + s) for r in range(n) for c in range(n) for s in (1, n) if (s == 1 and c < n - 1) or (s == n and r < n - 1)]
    return [(k, a, b, float(w)) for k, ((a, b), w) in enumerate(zip(pairs, rng.uniform(1, 5, len(pairs))))]


def laplacian(edges, n):
    a = np.zeros((n, n))
    for _, i, j, w in edges:
        a[i, i] += w
        a[j, j] += w
        a[i, j] -= w
        a[j, i] -= w
    return a


def rows_of(spark, matrices):
    rows = [(g, int(i), int(j), float(a[i, j])) for g, a in matrices.items() for i, j in zip(*np.nonzero(a))]
    a = spark.createDataFrame(rows, "g long, i long, j long, v double")
    return a, spark.createDataFrame([(g, i) for g, a in matrices.items() for i in range(len(a))], "g long, i long")


def test_lowest_of_groups(spark):
    """Groups of different sizes, one with fewer unknowns than vectors, one of an unknown without an entry."""
    matrices = {0: laplacian(grid(7, 0), 49), 5: laplacian(grid(3, 1), 9), 9: np.array([[1.0, -1.0], [-1.0, 1.0]]), 11: np.zeros((1, 1))}
    a, unknowns = rows_of(spark, matrices)
    x, values = eigen.lowest(a, unknowns, 3, 1e-6)
    found = {r.g: np.array(r["values"]) for r in values.collect()}
    vectors = {g: np.zeros((len(m), 3)) for g, m in matrices.items()}
    for r in x.collect():
        vectors[r.g][r.i] = r.x
    assert found.keys() == matrices.keys()
    for g, m in matrices.items():
        k = min(3, len(m))
        want = np.linalg.eigvalsh(m)[:k]
        assert np.allclose(found[g][:k], want, atol=1e-8) and not found[g][k:].any() and not vectors[g][:, k:].any()
        assert np.allclose(vectors[g][:, :k].T @ vectors[g][:, :k], np.eye(k), atol=1e-8)
        assert np.abs(m @ vectors[g][:, :k] - vectors[g][:, :k] * want).max() < 1e-4
        top = np.take_along_axis(vectors[g][:, :k], np.abs(vectors[g][:, :k]).argmax(0)[None], 0)
        assert (top > 0).all()
    with pytest.raises(RuntimeError, match="after 1 iterations"):
        eigen.lowest(a, unknowns, 3, 1e-12, 1)


def test_largest_and_no_rows(spark):
    a, unknowns = rows_of(spark, {3: laplacian(grid(4, 2), 16), 4: 2.5 * np.eye(2)})
    top = {r.g: r.v for r in eigen.largest(a, unknowns).collect()}
    assert abs(top[3] - np.linalg.eigvalsh(laplacian(grid(4, 2), 16))[-1]) < 1e-6 and abs(top[4] - 2.5) < 1e-9
    x, values = eigen.lowest(a.filter("false"), unknowns.filter("false"), 2)
    assert x.count() == 0 and values.count() == 0


@pytest.mark.parametrize("tolerance,entries", [(1.0, 0), (0.05, 1000)])
def test_targets_over_tables_are_the_dense_ones(spark, tolerance, entries):
    """Targets and trace samples span the same spaces on both sides of dense_entries, with all aggregates large or one."""
    n = 6
    edges = grid(n, 3)
    system = spectral.fine_system(spark.createDataFrame(edges, "edge long, v0 long, v1 long, w double"), spark.range(n * n).withColumnRenamed("id", "vertex"))
    part = spark.createDataFrame([(v, int(v % n > 1)) for v in range(n * n)], "vertex long, agg long")
    found = []
    # aggregate 0 has 18 vertices and 27 edges with its neighbours, aggregate 1 has 30 and 49
    for most in (1 << 23, entries):
        par = spectral.Parameters(spectral_tolerance=tolerance, max_vectors=3, max_traces=3, dense_entries=most, eigen_tolerance=1e-8)
        out = {}
        for r in spectral.vertex_targets(system, part, par).collect():
            out.setdefault((r.agg, r.kind), {}).setdefault(r.k, np.zeros(len(edges)))[r.i] = r.v
        found.append({key: np.column_stack([c[k] for k in sorted(c)]) for key, c in out.items()})
    assert found[0].keys() == found[1].keys()
    for key, x in found[0].items():
        y = found[1][key]
        assert x.shape == y.shape
        assert np.abs(x @ np.linalg.pinv(x) - y @ np.linalg.pinv(y)).max() < 1e-5


def test_what_needs_dense_problems_raises(spark):
    edges = grid(3, 4)
    system = spectral.fine_system(spark.createDataFrame(edges, "edge long, v0 long, v1 long, w double"), spark.range(9).withColumnRenamed("id", "vertex"))
    part = spark.createDataFrame([(v, v // 5) for v in range(9)], "vertex long, agg long")
    with pytest.raises(ValueError, match="dual traces"):
        spectral.vertex_targets(system, part, spectral.Parameters(dual=True, dense_entries=0))


@pytest.mark.parametrize("tolerance", [1.0, 0.05])
def test_targets_in_a_task_are_those_over_tables(spark, monkeypatch, tolerance):
    """An aggregate's eigenvectors over its entries of D, a task each."""
    edges = grid(6, 5)
    system = spectral.fine_system(spark.createDataFrame(edges, "edge long, v0 long, v1 long, w double"), spark.range(36).withColumnRenamed("id", "vertex"))
    part = spark.createDataFrame([(v, int(v % 6 > 1)) for v in range(36)], "vertex long, agg long")
    found, calls, solve = [], [], eigen.lowest
    monkeypatch.setattr(eigen, "lowest", lambda *a, **k: calls.append(1) or solve(*a, **k))
    for most in (0, 1 << 21):
        par = spectral.Parameters(spectral_tolerance=tolerance, max_vectors=4, max_traces=4, dense_entries=0, task_edofs=most, eigen_tolerance=1e-9)
        out = {}
        for r in spectral.vertex_targets(system, part, par).collect():
            out.setdefault((r.agg, r.kind), {}).setdefault(r.k, np.zeros(len(edges)))[r.i] = r.v
        found.append({key: np.column_stack([c[k] for k in sorted(c)]) for key, c in out.items()})
        assert bool(calls) == (most == 0)
        calls.clear()
    assert found[0].keys() == found[1].keys()
    for key, x in found[0].items():
        y = found[1][key]
        assert x.shape == y.shape and np.abs(x @ np.linalg.pinv(x) - y @ np.linalg.pinv(y)).max() < 1e-5


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_coarse_spaces_keep_the_constant(spark, most):
    """However loosely eigenvectors converge, with weights of ten powers of ten."""
    edges = [(k, a, b, 10.0 ** (k % 11 - 5)) for k, a, b, _ in grid(6, 5)]
    system = spectral.fine_system(spark.createDataFrame(edges, "edge long, v0 long, v1 long, w double"), spark.range(36).withColumnRenamed("id", "vertex"))
    part = spark.createDataFrame([(v, int(v % 6 > 1)) for v in range(36)], "vertex long, agg long")
    par = spectral.Parameters(spectral_tolerance=1.0, max_vectors=3, max_traces=3, dense_entries=0, task_edofs=most, eigen_tolerance=1e-4)
    u = {}
    for r in spectral.vertex_targets(system, part, par).filter("kind = 'u'").collect():
        u.setdefault(r.agg, {}).setdefault(r.k, {})[r.i] = r.v
    for columns in u.values():
        first = np.array(list(columns[0].values()))
        assert np.abs(first * np.sqrt(len(first)) - 1).max() < 1e-13
        assert all(abs(sum(c.values())) < 1e-13 for k, c in columns.items() if k)
