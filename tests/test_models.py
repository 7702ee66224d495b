"""Rescaling, hybridization, sampling, Monte Carlo, nonlinear flow, time steps and Krylov solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshgrain.functions import krylov
from meshgrain.operators import algebra, elements, hierarchy, montecarlo, nonlinear, spectral
from meshgrain.sources import grids


@pytest.fixture(scope="module")
def grid(spark):
    """An 8 x 8 grid of unit cells, a hierarchy of two levels, and each level's elements."""
    size = (8, 8, 1)
    cells = grids.cells(spark, size)
    perm = cells.select("cell", *[(1.0 + F.pmod("cell", F.lit(3))).alias(k) for k in ("kx", "ky", "kz")])
    rows = grids.numbered(grids.two_point_weights(grids.cell_faces(cells, size, 2), perm, (1.0, 1.0, 1.0)).filter("v1 is not null").drop("attr")).collect()
    edges = spark.createDataFrame(rows, "edge long, v0 long, v1 long, w double")
    part = spark.createDataFrame([(c, (c // 8 // 4) * 2 + c % 8 // 4) for c in range(64)], "vertex long, agg long")
    w = spark.createDataFrame([(i, i, 0.04) for i in range(64)], "i long, j long, v double")
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, cells.select(F.col("cell").alias("vertex")), w), [part], spectral.Parameters(spectral_tolerance=1.0))
    fine = elements.fine_elements(edges)
    return edges, part, h, [fine, elements.coarse_elements(fine, part, h.steps[0].s)]


def matrix(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


def test_rescaling(spark, grid):
    edges, part, h, el = grid
    c = spark.createDataFrame([(a, a + 1.0) for a in range(4)], "i long, v double")
    by_vertex = part.join(c, part["agg"] == c.i).select(F.col("vertex").alias("i"), "v")
    n = h.systems[1].edofs.count()
    direct = algebra.galerkin(elements.assemble(el[0], by_vertex), h.steps[0].s)
    assert np.allclose(matrix(elements.assemble(el[1], c), n, n), matrix(direct, n, n), rtol=1e-12, atol=1e-14)
    assert np.allclose(matrix(elements.assemble(el[0]), 112, 112), matrix(h.systems[0].m, 112, 112))
    x = spark.createDataFrame([(k, float(k % 5)) for k in range(112)], "i long, v double")
    a, b = elements.apply(el[0], x, by_vertex), algebra.matvec(elements.assemble(el[0], by_vertex), x)
    assert np.allclose([r.v for r in a.sort("i").collect()], [r.v for r in b.sort("i").collect()])


@pytest.mark.parametrize("level", [0, 1])
def test_hybrid_agrees(spark, grid, level):
    _, _, h, el = grid
    f = spark.createDataFrame([(i, 1.0 if i < 32 else -1.0) for i in range(64)], "i long, v double")
    f = h.restrict(0, f) if level else f
    for system in (h.systems[level], spectral.System(**{**h.systems[level].__dict__, "w": None})):
        s, u = hierarchy.solve(system, f)
        hs, hu = elements.hybrid_solve(system, el[level], f)
        for a, b in ((s, hs), (u, hu)):
            assert np.allclose([r.v for r in a.sort("i").collect()], [r.v for r in b.sort("i").collect()], atol=1e-7)


def test_upscaled_error_is_small(spark, grid):
    _, _, h, _ = grid
    f = spark.createDataFrame([(i, 1.0 if i < 32 else -1.0) for i in range(64)], "i long, v double")
    e = h.errors(1, f)
    assert e["vertex"] < 0.1 and e["complexity"] > 1


def test_time_steps_decay(spark, grid):
    _, _, h, _ = grid
    u = spark.createDataFrame([(i, float(i == 0)) for i in range(64)], "i long, v double")
    ones = spark.createDataFrame([(i, 1.0) for i in range(64)], "i long, v double")
    for _ in range(2):
        _, u = elements.step_in_time(h.systems[0], u, ones, 0.5)
    v = np.array([r.v for r in u.sort("i").collect()])
    assert abs(v.sum() - 1) < 1e-9 and 0 < v.max() < 1


def test_monte_carlo(spark, grid):
    _, _, h, el = grid
    ls = montecarlo.levels(h, el)
    field = montecarlo.Field(ls, volume=1.0, correlation=5.0, seed=3)
    plain = [montecarlo.Level(**{**l.__dict__, "w": None}) for l in ls]
    f = np.where(np.arange(64) < 32, 1.0, -1.0)
    q = montecarlo.functional(np.full(64, 1 / 64) * (np.arange(64) < 32))(plain)
    # with the coefficient 1 + s the potential is divided by it
    const = montecarlo.samples(spark, plain, montecarlo.Constant(plain), q, f, {0: range(3), 1: range(3)}).toPandas()
    fine = const[const.level == 0].sort_values("sample").finer.to_numpy()
    assert np.allclose(fine[0] / fine, [1, 2, 3])
    value, stats = montecarlo.estimate(spark, plain, field, q, f, first=12, more=16)
    t = stats.toPandas().set_index("level")
    assert np.isfinite(value) and t.variance[0] < t.variance[1] and t.n.sum() == 40
    again, _ = montecarlo.estimate(spark, plain, field, q, f, first=12, more=0)
    assert again == montecarlo.estimate(spark, plain, field, q, f, first=12, more=0)[0]


def test_next_level():
    assert montecarlo.next_level({0: 10, 1: 10}, {0: 1.0, 1: 100.0}, {0: 1.0, 1: 1.0}) == 1
    assert montecarlo.next_level({0: 10, 1: 90}, {0: 1.0, 1: 1.0}, {0: 1.0, 1: 1.0}) == 0


def test_nonlinear(spark, grid):
    _, _, h, el = grid
    ls = montecarlo.levels(h, el)
    f = np.where(np.arange(64) < 32, 0.2, -0.2)
    k = nonlinear.Conductivity(0.5)
    newton, picard, multi = (nonlinear.solve(l, k, f, newton=n) for l, n in ((ls[:1], True), (ls[:1], False), (ls, True)))
    assert max(r.residual for r in (newton, picard, multi)) < 1e-7
    assert np.allclose(newton.potential, picard.potential, atol=1e-5) and np.allclose(newton.potential, multi.potential, atol=1e-5)
    assert newton.iterations < picard.iterations and multi.iterations <= newton.iterations
    other = nonlinear.Conductivity(2.0, beta=2.0)
    u = np.array([0.3, -0.7])
    assert np.allclose(other.inverse_slope(u), (1 / other.value(u + 1e-6) - 1 / other.value(u - 1e-6)) / 2e-6, atol=1e-6)


def test_krylov():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 30))
    spd, sym, b = a @ a.T + np.eye(30), a + a.T, rng.normal(size=30)
    for m, solver in ((spd, krylov.conjugate_gradients), (sym, krylov.minres), (a, krylov.gmres)):
        assert np.linalg.norm(m @ solver(lambda x: m @ x, b).x - b) < 1e-5


def test_components_of_the_coefficient(spark, grid):
    edges, part, h, el = grid
    parts = elements.coefficient_components(h.systems[0], part, h.steps[0].s)
    n = h.systems[1].edofs.count()
    one = spark.createDataFrame([(a, 1.0) for a in range(4)], "i long, v double")
    assert np.allclose(matrix(elements.assemble_components(parts, one), n, n), matrix(h.systems[1].m, n, n))
    # a constant coefficient agrees with the elements; faces go by the mean of both sides
    three = one.withColumn("v", F.lit(3.0))
    assert np.allclose(matrix(elements.assemble_components(parts, three), n, n), matrix(elements.assemble(el[1], three), n, n))


def test_studies(spark, grid):
    from meshgrain.operators import nonlinear
    from meshgrain.plans import drivers

    edges, part, h, el = grid
    whole = hierarchy.Hierarchy.build(spectral.fine_system(edges, part.select("vertex")), [part], spectral.Parameters(spectral_tolerance=1.0))
    a = matrix(algebra.congruence(algebra.transpose(whole.systems[0].d), whole.systems[0].m.select("i", (1 / F.col("v")).alias("v"))), 64, 64)
    x = spark.createDataFrame([(i, float(i // 8) - 3.5 + 0.1 * (i % 3)) for i in range(64)], "i long, v double")
    exact = np.linalg.eigvalsh(a)[1]
    assert abs(drivers.inverse_power(whole, 0, x, 8, 0.0) / exact - 1) < 0.05
    assert abs(drivers.inverse_power(whole, 1, x, 8, 0.0) / exact - 1) < 0.15
    ls = montecarlo.levels(h, el)
    s = drivers.field_statistics(spark, montecarlo.Field(ls, 1.0, 5.0, seed=2), 1, 100).toPandas()
    assert len(s) == 4 and (s.n == 100).all() and (s["mean"].abs() < 1).all()
    plain = [montecarlo.Level(**{**l.__dict__, "w": None}) for l in ls]
    t = drivers.nonlinear_iterations(spark, plain, nonlinear.Conductivity(0.5), np.where(np.arange(64) < 32, 0.2, -0.2)).toPandas()
    assert len(t) == 4 and (t.residual < 1e-7).all()


def test_preconditioners():
    from meshgrain.operators import kernels

    n = 40
    a = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    blocks = [np.arange(k, k + 4) for k in range(0, n, 4)]
    coarse = np.kron(np.eye(10), np.ones((4, 1)))
    b = np.arange(n, dtype=float)
    plain, jacobi, two = (krylov.conjugate_gradients(lambda x: a @ x, b, p) for p in (lambda r: r, kernels.block_jacobi(a, blocks), kernels.two_level(a, blocks, coarse)))
    assert all(np.linalg.norm(a @ s.x - b) < 1e-5 for s in (plain, jacobi)) and jacobi.iterations < plain.iterations
    assert np.linalg.norm(a @ two.x - b) < 1e-4 or two.iterations < plain.iterations
    unit = np.ones(3) / np.sqrt(3)
    assert np.allclose(unit @ kernels.deflate(np.eye(3), unit), 0) and kernels.beside(unit, np.eye(3)).shape == (3, 3)


def test_solver_by_name(spark, grid):
    """Dense, conjugate gradients and minimal residuals agree; what can't be done raises."""
    _, _, h, _ = grid
    f = spark.createDataFrame([(i, 1.0 if i < 32 else -1.0) for i in range(64)], "i long, v double")
    dense = [r.v for r in h.solve(0, f, method="dense")[1].sort("i").collect()]
    assert np.allclose(dense, [r.v for r in h.solve(0, f, method="cg", tolerance=1e-8, most=100)[1].sort("i").collect()], atol=1e-6)
    with pytest.raises(RuntimeError):
        h.solve(0, f, method="cg", most=2)
    assert sorted(r.v for r in h.sizes(1).collect()) == pytest.approx([16.0] * 4) and h.info().collect()[1].vertices == 4


def test_inverse_iteration(spark):
    """The second eigenvector of a path, up to its sign, by solves over tables and by the dense eigenproblem."""
    e = grids.path(spark, 12)
    dense = np.array([r.v for r in hierarchy.fiedler(e).sort("i").collect()])
    found = hierarchy.inverse_iteration(spectral.fine_system(e, spark.range(12).withColumnRenamed("id", "vertex")), 6, 1e-4)
    found = np.array([r.v for r in found.sort("i").collect()])
    assert np.allclose(dense, found * np.sign(found @ dense), atol=0.02)
    k = np.arange(12)
    exact = np.cos(np.pi * (k + 0.5) / 12)
    assert np.allclose(abs(dense @ exact / np.linalg.norm(exact)), 1)


def test_picard_over_tables(spark, grid):
    """Potentials agree with those of the iteration on arrays."""
    edges, _, h, el = grid
    system = spectral.System(**{**h.systems[0].__dict__, "w": None})
    f = spark.createDataFrame([(i, 0.2 if i < 32 else -0.2) for i in range(64)], "i long, v double")
    x, history = nonlinear.picard(system, el[0], nonlinear.Conductivity(0.5), f, relative=1e-6)
    assert len(history) > 2 and history[-1] < 1e-6 * history[0] * 2
    ls = [montecarlo.Level(**{**level.__dict__, "w": None}) for level in montecarlo.levels(h, el)]
    want = nonlinear.solve(ls[:1], nonlinear.Conductivity(0.5), np.where(np.arange(64) < 32, 0.2, -0.2), newton=False).potential
    got = np.array([r.v for r in x.filter("block = 1").sort("i").collect()])
    assert np.allclose(got - got.mean(), want - want.mean(), atol=1e-4)


def test_white_noise_and_lognormal(spark, grid):
    _, _, h, _ = grid
    ids = spark.range(20000).withColumnRenamed("id", "i")
    s = montecarlo.white_noise(ids, 3).agg(F.avg("v"), F.var_samp("v"), F.avg(F.col("v") ** 3)).first()
    assert abs(s[0]) < 0.03 and abs(s[1] - 1) < 0.05 and abs(s[2]) < 0.1
    assert montecarlo.white_noise(ids.repartition(7), 3).exceptAll(montecarlo.white_noise(ids, 3)).isEmpty()
    volumes = spark.range(64).select(F.col("id").alias("i"), F.lit(1.0).alias("v"))
    k = np.array([r.v for r in montecarlo.lognormal(h.systems[0], volumes, 5.0).sort("i").collect()])
    assert len(k) == 64 and (k > 0).all() and np.log(k).std() > 0.05


def test_slices_of_a_grid(spark):
    size, spacing = (3, 4, 2), (1.0, 2.0, 5.0)
    cells = grids.cells(spark, size)
    k = cells.select("ix", "iy", "iz", *[(F.lit(s) * (1 + F.col("cell"))).alias(n) for s, n in ((1.0, "kx"), (2.0, "ky"), (3.0, "kz"))])
    for plane, n, inner in (("none", 24, 2 * 8 + 3 * 3 * 2 + 12), ("xy", 12, 8 + 9), ("xz", 6, 4 + 3), ("yz", 8, 6 + 4)):
        e, grid = grids.reservoir(spark, k, size, spacing, plane, 1 if plane == "xy" else 0)
        assert grid.count() == n and e.filter("v1 is not null").count() == inner
    # xy at iz = 1: cells 12 and 13 are neighbours in x; half weights k * 2 * (2 * 5) / 1
    w = {(r.v0, r.v1): r.w for r in grids.reservoir(spark, k, size, spacing, "xy", 1)[0].filter("v1 is not null").collect()}
    assert w[0, 1] == pytest.approx(1 / (1 / (13 * 20.0) + 1 / (14 * 20.0)))


def test_files_of_levels(spark, grid, tmp_path):
    from meshgrain.sources import files

    _, _, h, _ = grid
    files.write_levels({"pu": [h.steps[0].u], "m": [s.m for s in h.systems]}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "m")).filter("level = 1").count() == h.systems[1].m.count()
    nested = spark.createDataFrame([((1, (2.5, "x")), 3)], "a struct<b: int, c: struct<d: double, e: string>>, f int")
    assert files.flattened(nested).columns == ["a-b", "a-c-d", "a-c-e", "f"] and tuple(files.flattened(nested).first()) == (1, 2.5, "x", 3)


def test_text_read_by_blocks(spark, tmp_path):
    """A vector of many lines, read in blocks of a few KB, comes in the order of the file."""
    from meshgrain.sources import files

    values = np.random.default_rng(0).random(30000).round(6)
    (tmp_path / "v.txt").write_text("".join(f"{v}{' ' if k % 3 else chr(10)}" for k, v in enumerate(values)) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        t = files.read_vector(spark, str(tmp_path / "v.txt")).sort("i").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.i for r in t] == list(range(30000)) and np.allclose([r.v for r in t], values)


def test_parts_are_balanced(spark):
    """A star grows no part beyond twice the mean; all vertices are placed once."""
    e = spark.createDataFrame([(k, 0, k + 1, 1.0) for k in range(99)], "edge long, v0 long, v1 long, w double")
    from meshgrain.operators import partition

    p = partition.grow(e, spark.range(100).withColumnRenamed("id", "vertex"), 4).toPandas()
    sizes = p.groupby("agg").size()
    assert len(p) == 100 and p.vertex.is_unique and sizes.max() <= 50


def test_eigenvalues(spark):
    """Published least eigenvalues of the second difference matrix and of the stiffness and mass matrices of linear elements."""
    from meshgrain.operators import kernels

    a = 2 * np.eye(10) - np.eye(10, k=1) - np.eye(10, k=-1)
    assert kernels.smallest_pairs(a, 1, 1.0)[0][0] == pytest.approx(0.08101405, abs=1e-6)
    h = 1 / 11
    mass = h / 6 * (4 * np.eye(10) + np.eye(10, k=1) + np.eye(10, k=-1))
    values, vectors = kernels.smallest_pairs(a / h, 1, 1.0, mass)
    assert values[0] == pytest.approx(9.93687142, abs=1e-6)
    assert np.allclose(a / h @ vectors[:, 0], values[0] * mass @ vectors[:, 0])


def test_hybrid_over_tables(spark, grid, monkeypatch):
    """The system of multipliers by conjugate gradients over tables gives the driver's solution."""
    _, _, h, el = grid
    f = spark.createDataFrame([(i, 1.0 if i < 32 else -1.0) for i in range(64)], "i long, v double")
    f = h.restrict(0, f)
    s, u = elements.hybrid_solve(h.systems[1], el[1], f)
    monkeypatch.setattr(hierarchy, "LOCAL_DOFS", 3)
    ts, tu = elements.hybrid_solve(h.systems[1], el[1], f)
    for a, b in ((s, ts), (u, tu)):
        assert np.allclose([r.v for r in a.sort("i").collect()], [r.v for r in b.sort("i").collect()], atol=1e-6)


def test_dumps_of_samples(spark, grid, tmp_path):
    """What is read back is what the samples have; a second plan replaces its own samples and leaves the others."""
    _, _, h, el = grid
    ls = montecarlo.levels(h, el)
    field, path = montecarlo.Field(ls, volume=1.0, correlation=5.0, seed=3), str(tmp_path / "dump")
    f = np.where(np.arange(64) < 32, 1.0, -1.0)
    by = [f, ls[0].u.T @ f]
    montecarlo.dump(spark, ls, field, {0: range(2), 1: range(3)}, path, f)
    before = {}
    for again in (False, True):
        if again:
            montecarlo.dump(spark, ls, field, {1: range(2, 5)}, path, f)
        for name, n in (("coefficient", 0), ("flux", 1), ("potential", 2)):
            t = montecarlo.dumped(spark, path, name).toPandas()
            assert not t.duplicated(["level", "sample", "i"]).any()
            assert sorted(set(zip(t["level"], t["sample"]))) == [(0, 0), (0, 1), *((1, k) for k in range(5 if again else 3))]
            for (level, sample), rows in t.groupby(["level", "sample"]):
                c = field.coefficient(sample, level)
                want = (c, *ls[level].solve(by[level], c))[n]
                got = rows.sort_values("i")["v"].to_numpy()
                assert np.array_equal(before.setdefault((name, level, sample), got), got) and np.allclose(got, want, rtol=1e-12, atol=1e-12)
    plan = montecarlo.dumped(spark, path, "flux").filter("level = 1 and sample = 4")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and "PushedFilters: []" in plan
    montecarlo.dump(spark, ls, field, {0: range(1)}, str(tmp_path / "fields"))
    assert montecarlo.dumped(spark, str(tmp_path / "fields"), "flux").isEmpty() and montecarlo.dumped(spark, str(tmp_path / "fields"), "coefficient").count() == 64
