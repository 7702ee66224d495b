"""Dual traces, vertices that stay alone, and coefficients on levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshgrain.operators import algebra, elements, hierarchy, kernels, montecarlo, partition, spectral
from meshgrain.sources import checkpoints, grids


def grid(spark, n=6):
    size = (n, n, 1)
    cells = grids.cells(spark, size)
    k = F.when(F.pmod("cell", F.lit(n)) < n // 2, 1.0).otherwise(50.0)  # two weights
    e = grids.two_point_weights(grids.cell_faces(cells, size, 2), cells.select("cell", *[k.alias(c) for c in ("kx", "ky", "kz")]), (1.0, 1.0, 1.0))
    e = checkpoints.written(grids.numbered(e.filter("v1 is not null").select("edge", "v0", "v1", "w")))
    return e, partition.cartesian(cells, (n // 2, n // 2, 1), size), cells.select(F.col("cell").alias("vertex"))


@pytest.mark.parametrize("scaled,energy", [(False, False), (True, False), (False, True), (True, True)])
def test_dual_traces_span_the_samples_of_both_sides(spark, scaled, energy):
    e, part, v = grid(spark)
    system = spectral.fine_system(e, v)
    par = spectral.Parameters(spectral_tolerance=1.0, max_traces=3, dual=True, dual_scaled=scaled, dual_energy=energy)
    traces = spectral.face_traces(system, part, spectral.vertex_targets(system, part, par), par).toPandas()
    edges = e.toPandas().set_index("edge")
    agg = part.toPandas().set_index("vertex")["agg"]

    def samples(a):
        """The three least eigenvectors by the definition, on the aggregate and its neighbours."""
        own = set(agg[agg == a].index)
        ext = sorted(own | {y for x, y in [*zip(edges.v0, edges.v1), *zip(edges.v1, edges.v0)] if x in own})
        inside = edges[edges.v0.isin(ext) & edges.v1.isin(ext)]
        d = np.zeros((len(ext), len(inside)))
        for j, (x, y) in enumerate(zip(inside.v0, inside.v1)):
            d[ext.index(x), j], d[ext.index(y), j] = 1, -1
        minv, b = np.diag(inside.w), abs(d)
        x = d @ minv @ d.T + b @ minv @ b.T
        assert np.allclose(x, np.diag(np.diag(x)))
        lap = minv - minv @ b.T @ np.linalg.inv(x) @ b @ minv
        m = np.linalg.inv(minv)
        lap = m @ lap @ m if scaled else lap
        inner = m + d.T @ d if energy else np.eye(len(m))
        half = np.linalg.cholesky(inner)
        values, u = np.linalg.eigh(np.linalg.inv(half) @ lap @ np.linalg.inv(half).T)
        assert abs(values[0]) < 1e-9
        return inside.index.to_numpy(), np.linalg.inv(half).T @ u[:, :3]

    for (a, b), face in traces.groupby(["a", "b"]):
        ids = np.sort(face.i.unique())
        got = face.pivot(index="i", columns="k", values="v").loc[ids].to_numpy()
        flow = np.array([1.0 if agg[edges.v0[i]] == a else -1.0 for i in ids])
        assert np.isclose(flow @ got[:, 0], 1) and np.allclose(flow @ got[:, 1:], 0, atol=1e-9)
        want = []
        for side in (a, b):
            where, s = samples(side)
            want.append(s[np.searchsorted(where, ids)])
        space = np.column_stack([got[:, 0], *want])
        assert np.linalg.matrix_rank(np.column_stack([space, got]), tol=1e-8) == np.linalg.matrix_rank(space, tol=1e-8)
        assert got.shape[1] == min(3, np.linalg.matrix_rank(space, tol=1e-8))


def test_dual_traces_solve_with_small_errors(spark):
    e, part, v = grid(spark)
    f = v.select(F.col("vertex").alias("i"), F.when(F.col("vertex") == 0, 1.0).when(F.col("vertex") == 35, -1.0).otherwise(0.0).alias("v"))
    found = {}
    for dual in (False, True):
        h = hierarchy.Hierarchy.build(spectral.fine_system(e, v), [part], spectral.Parameters(spectral_tolerance=1.0, dual=dual))
        found[dual] = h.errors(1, f)
    assert found[True]["div"] < 1 and found[True]["edge"] < 1.2 * found[False]["edge"] and found[True]["complexity"] == found[False]["complexity"]


def test_edges_of_a_star_have_a_null_vector():
    d = np.array([[1.0, 1, 1], [-1, 0, 0], [0, -1, 0], [0, 0, -1]])
    a, b = kernels.dual_system(d, np.array([1.0, 2.0, 3.0]), energy=True)
    assert abs(np.linalg.eigvalsh(a)[0]) < 1e-12 and (np.linalg.eigvalsh(b) > 0).all()


def test_vertices_stay_alone_on_three_levels(spark):
    e, part, v = grid(spark)
    alone = spark.createDataFrame([(7,), (20,)], "vertex long")
    h = hierarchy.Hierarchy.build(spectral.fine_system(e, v), [part, None], spectral.Parameters(max_vectors=1, max_traces=1, coarsening=3.0), alone=alone)
    down = {r.vertex: (r.vertex,) for r in v.collect()}
    for k in range(2):
        to = {r.vertex: r.agg for r in h.partitions[k].collect()}
        assert set(to.values()) == set(range(len(set(to.values()))))
        down = {x: (*path, to[path[-1]]) for x, path in down.items()}
        for x in (7, 20):
            assert [y for y, path in down.items() if path[-1] == down[x][-1]] == [x]
    assert len({path[-1] for path in down.values()}) < 6 and sorted(r.vertex for r in h.alone[1].collect()) == sorted(down[x][1] for x in (7, 20))


def test_coefficients_on_levels_agree_with_a_rebuild(spark):
    e, part, v = grid(spark)
    system, fine = spectral.fine_system(e, v), elements.fine_elements(e)
    par = spectral.Parameters(spectral_tolerance=1.0)
    h = hierarchy.Hierarchy.build(system, [part], par, elements=fine)
    k = spark.createDataFrame([(a, 1.0 + a) for a in range(4)], "i long, v double")
    got = h.rescaled(1, k)
    down = part.join(k.select(F.col("i").alias("agg"), "v"), "agg").select(F.col("vertex").alias("i"), "v")
    want = algebra.galerkin(h.rescaled(0, down).m, h.steps[0].s)  # the fine M of the same coefficient, coarsened by the same space
    wide = lambda m: {(r.i, r.j): r.v for r in m.filter("abs(v) > 1e-13").collect()}
    a, b = wide(got.m), wide(want)
    assert set(a) == set(b) and all(abs(a[x] - b[x]) <= 1e-10 * abs(b[x]) + 1e-13 for x in b)
    one = h.rescaled(1, k.withColumn("v", F.lit(1.0)))
    assert all(abs(x - wide(h.systems[1].m)[i]) < 1e-10 for i, x in wide(one.m).items())
    with pytest.raises(ValueError):
        hierarchy.Hierarchy.build(system, [part], par).rescaled(1, k)
    assert [r.seconds > 0 for r in h.info().sort("level").collect()] == [False, True]


def test_corrections_on_coarse_levels_need_fewer_iterations(spark):
    n = 24
    size = (n, n, 1)
    cells = grids.cells(spark, size)
    e = grids.cell_faces(cells, size, 2).filter("cell1 is not null").select(F.col("cell0").alias("v0"), F.col("cell1").alias("v1"))
    e = checkpoints.written(algebra.numbered(e, "edge", "v0", "v1").withColumn("w", F.lit(1.0)))
    v = cells.select(F.col("cell").alias("vertex"))
    part = partition.cartesian(cells, (4, 4, 1), size)
    system = spectral.fine_system(e, v)
    u = spectral.vertex_targets(system, part, spectral.Parameters(spectral_tolerance=1.0, max_vectors=3)).filter("kind = 'u'")
    p = checkpoints.written(u.select("i", (F.col("agg") * 8 + F.col("k")).alias("j"), "v"))
    f = v.select(F.col("vertex").alias("i"), F.when(F.col("vertex") == 0, 1.0).when(F.col("vertex") == n * n - 1, -1.0).otherwise(0.0).alias("v"))
    counts, found = [], []
    for transfers in ((), (p,)):
        history = []
        _, x = hierarchy.conjugate_gradients(system, f, tolerance=1e-6, transfers=transfers, history=history)
        counts.append(len(history))
        found.append(np.array([r.v for r in x.sort("i").collect()]))
    assert np.allclose(found[0], found[1], atol=1e-4) and counts[1] < 0.6 * counts[0]


def test_noise_of_a_level_has_the_covariance_of_the_restricted_noise(spark):
    e, part, v = grid(spark)
    w = v.select(F.col("vertex").alias("i"), F.col("vertex").alias("j"), (1.0 + F.pmod("vertex", F.lit(3))).alias("v"))
    system = spectral.fine_system(e, v, w)
    u = spectral.vertex_targets(system, part, spectral.Parameters(spectral_tolerance=1.0, max_vectors=2)).filter("kind = 'u'")
    p = checkpoints.written(u.select("i", (F.col("agg") * 8 + F.col("k")).alias("j"), "v"))
    vdofs = p.select(F.col("j").alias("vdof"), F.floor(F.col("j") / 8).alias("vertex")).distinct()
    coarse = algebra.galerkin(w, p)
    ids = sorted(r.vdof for r in vdofs.collect())
    dense = lambda m: hierarchy._local(m, np.array(ids), np.array(ids))
    root, want = dense(montecarlo.block_root(coarse, vdofs)), dense(coarse)
    assert np.allclose(root @ root, want) and np.count_nonzero(np.abs(want) > 1e-12) > len(ids)
    draws = spark.range(20000).crossJoin(spark.range(len(ids)).toDF("k"))  # a small test's numbers
    x = np.array([r.v for r in montecarlo.white_noise(draws.select((F.col("id") * 100 + F.col("k")).alias("i")), 5).sort("i").collect()]).reshape(20000, -1)
    assert np.abs(np.cov((x @ root).T) - want).max() < 0.12
    noise = montecarlo.level_noise(spectral.System(vdofs, system.edofs, system.m, system.d, system.constant, coarse), 3, 2.0).sort("i").toPandas()
    one = np.array([r.v for r in montecarlo.white_noise(vdofs.select(F.col("vdof").alias("i")), 3).sort("i").collect()])
    assert np.allclose(noise["v"], 2 * root @ one)
    with pytest.raises(ValueError):
        montecarlo.block_root(coarse, vdofs.select("vdof", F.col("vdof").alias("vertex")))
