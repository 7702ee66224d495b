"""Spectral coarsening of a graph's mixed system: local eigenproblems, traces, and the coarse space's transfer matrices.

A level is a `System`: vdofs (vdof, vertex), edofs (edof, v0, v1), with v0 = v1 for a dof inside a vertex, M and D as
(i, j, v), and the constant's representation (i, v). A partition (vertex, agg) makes aggregates; edofs between two
aggregates belong to the face of both. Kernels run in groups, an aggregate or face each, and see the rows of M and D that
they need and no others. All numbering is by explicit keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import written
from . import algebra, eigen
from .kernels import dual_system, fix_signs, one_minus_one, orthogonal_to_first, saddle_solve, smallest_pairs
from .topology import signed_incidence


@dataclass(frozen=True)
class Parameters:
    max_levels: int = 2
    spectral_tolerance: float = 1e-3
    max_vectors: int = 4
    max_traces: int = 4
    coarsening: float = 64.0
    #: Trace samples by eigenvectors of the edges' Laplacian, where M is diagonal; with M on both sides; in the energy M + D^T D.
    dual: bool = False
    dual_scaled: bool = False
    dual_energy: bool = False
    #: Aggregates whose vdofs and edofs, with the neighbours', make more entries of a dense D than this have their eigenvectors over tables,
    #: with residuals of at most eigen_tolerance times the largest diagonal entry. Those need a diagonal M and have no dual samples.
    dense_entries: int = 1 << 23
    eigen_tolerance: float = 1e-7
    #: Of these aggregates, those with up to so many edofs iterate in a task each, over D's entries alone.
    task_edofs: int = 1 << 21


@dataclass(frozen=True)
class System:
    vdofs: DataFrame
    edofs: DataFrame
    m: DataFrame
    d: DataFrame
    constant: DataFrame
    w: DataFrame | None = None


@dataclass(frozen=True)
class Coarsening:
    """u: P_u and s: P_sigma, as (i, j, v); q: the projector of edges, Q_sigma P_sigma = 1; coarse: the next level."""

    u: DataFrame
    s: DataFrame
    q: DataFrame
    coarse: System


def fine_system(edges: DataFrame, vertices: DataFrame, w: DataFrame | None = None) -> System:
    """The mixed system of a graph (edge, v0, v1, w): M = diag(1 / w), D the signed incidence."""
    v = vertices.select("vertex").distinct()
    return System(
        v.select(F.col("vertex").alias("vdof"), "vertex"), edges.select(F.col("edge").alias("edof"), "v0", "v1"),
        edges.select(F.col("edge").alias("i"), F.col("edge").alias("j"), (1 / F.col("w")).alias("v")), signed_incidence(edges),
        v.select(F.col("vertex").alias("i"), F.lit(1.0).alias("v")), w,
    )


def _within(a: DataFrame, rows: DataFrame, columns: DataFrame, kind: str) -> DataFrame:
    """(g, kind, i, j, v): a matrix's entries whose row (g, i) and column (g, j) are a group's. Columns first: these are edofs, with few
    entries each, while a vertex of many edges has entries in all of its groups that a group has no use for."""
    r, c = rows.select("g", F.col("dof").alias("i")), columns.select("g", F.col("dof").alias("j"))
    return a.join(c, "j").join(r, ["g", "i"]).select("g", F.lit(kind).alias("kind"), "i", "j", "v")


def _marks(t: DataFrame, kind: str, i: str, j: str | None = None, v: str | None = None) -> DataFrame:
    return t.select("g", F.lit(kind).alias("kind"), F.col(i).cast("long").alias("i"), (F.col(j).cast("long") if j else F.lit(0).cast("long")).alias("j"), (F.col(v).cast("double") if v else F.lit(0.0)).alias("v"))


class _Group:
    """The rows of one group, by kind, as dense arrays over sorted dofs."""

    def __init__(self, table: pd.DataFrame):
        self.by = {k: t for k, t in table.groupby("kind")}

    def rows(self, kind: str) -> pd.DataFrame:
        return self.by[kind] if kind in self.by else pd.DataFrame({"i": np.zeros(0, int), "j": np.zeros(0, int), "v": np.zeros(0)})

    def ids(self, kind: str) -> np.ndarray:
        return np.unique(self.rows(kind)["i"].to_numpy())

    def dense(self, kind: str, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        t = self.rows(kind)
        t = t[t["i"].isin(rows) & t["j"].isin(columns)]
        out = np.zeros((len(rows), len(columns)))
        np.add.at(out, (np.searchsorted(rows, t["i"]), np.searchsorted(columns, t["j"])), t["v"])
        return out

    def mass(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """A matrix over ids, or its diagonal alone where it has nothing else."""
        t = self.rows(kind)
        return self.vector(kind, ids) if (t["i"] == t["j"]).all() else self.dense(kind, ids, ids)

    def vector(self, kind: str, ids: np.ndarray) -> np.ndarray:
        t = self.rows(kind).set_index("i")["v"]
        return t.reindex(ids).fillna(0.0).to_numpy()


def _entries(blocks: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], column: str) -> pd.DataFrame:
    """(kind, i, column, v) of dense blocks (kind, row ids, column ids, values)."""
    join = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
    kinds = np.array([k for k, i, j, _ in blocks for _ in range(len(i) * len(j))], object)
    rows, columns = join([np.repeat(i, len(j)) for _, i, j, _ in blocks], np.int64), join([np.tile(j, len(i)) for _, i, j, _ in blocks], np.int64)
    return pd.DataFrame({"kind": kinds, "i": rows, column: columns, "v": join([v.ravel() for *_, v in blocks], np.float64)})


def _placed(system: System, partition: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vdofs and edofs with their aggregates: (vdof, agg) and (edof, a, b)."""
    p = partition.select("vertex", "agg")
    v = system.vdofs.join(p, "vertex").select("vdof", "agg")
    a, b = (p.select(F.col("vertex").alias(k), F.col("agg").alias(n)) for k, n in (("v0", "a"), ("v1", "b")))
    return v, system.edofs.join(a, "v0").join(b, "v1").select("edof", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def vertex_targets(system: System, partition: DataFrame, par: Parameters) -> DataFrame:
    """(agg, kind, i, k, v): kind u, target k of an aggregate at vdof i; kind s, trace sample k at edof i.

    The eigenvectors are those of D M^-1 D^T on the aggregate and its neighbouring vertices, with the edofs inside. Samples are their
    fluxes, or, with par.dual, eigenvectors of the edges' own Laplacian there.
    """
    ends = system.edofs.filter("v0 <> v1")
    near = ends.select(F.col("v0").alias("x"), F.col("v1").alias("y")).unionByName(ends.select(F.col("v1").alias("x"), F.col("v0").alias("y"))).distinct()
    own = partition.select(F.col("agg").alias("g"), "vertex")
    ext = own.unionByName(own.join(near, own.vertex == near.x).select("g", F.col("y").alias("vertex"))).distinct()
    ev = ext.join(system.vdofs, "vertex").select("g", F.col("vdof").alias("dof"))
    e0, e1 = (ext.select("g", F.col("vertex").alias(k)) for k in ("v0", "v1"))
    ee = system.edofs.join(e0, "v0").join(e1, ["g", "v1"]).select("g", F.col("edof").alias("dof"))
    mine = own.join(system.vdofs, "vertex").select("g", F.col("vdof").alias("dof"))
    count = lambda t, c: t.groupBy("g").agg(F.count(F.lit(1)).alias(c))
    big = written(count(ev, "nv").join(count(ee, "ne"), "g").filter(F.col("nv") * F.col("ne") > par.dense_entries).select("g", "ne"), "large")
    large = []
    for one, solve in ((F.col("ne") <= par.task_edofs, _task_targets), (F.col("ne") > par.task_edofs, _large_targets)):
        if not (these := big.filter(one).select("g")).isEmpty():
            large.append(solve(system, *(t.join(F.broadcast(these), "g", "left_semi") for t in (ev, ee, mine)), par))
    if large:
        ev, ee, mine = (t.join(F.broadcast(big), "g", "left_anti") for t in (ev, ee, mine))
    rows = _marks(ev, "v", "dof").unionByName(_marks(ee, "e", "dof")).unionByName(_marks(mine, "own", "dof")).unionByName(_within(system.m, ee, ee, "m")).unionByName(_within(system.d, ev, ee, "d"))
    most, traces, tolerance = par.max_vectors, par.max_traces, par.spectral_tolerance

    def kernel(key, table: pd.DataFrame) -> pd.DataFrame:
        g = _Group(table)
        v, e, own_ = g.ids("v"), g.ids("e"), g.ids("own")
        if len(v) == 1 or not len(e):
            targets, samples = np.ones((len(own_), 1)) / np.sqrt(len(own_)), np.zeros((len(e), 0))
        else:
            m, d = g.mass("m", e), g.dense("d", v, e)
            flux = d.T / m[:, None] if m.ndim == 1 else np.linalg.solve(m, d.T)
            _, vectors = smallest_pairs(d @ flux, max(most, traces), tolerance)
            samples = flux @ vectors[:, 1:]
            if par.dual and m.ndim == 1:
                # a vertex without an edge inside has no row
                a, b = dual_system(d[np.abs(d).sum(1) > 0], 1 / m, par.dual_scaled, par.dual_energy)
                values, samples = smallest_pairs(a, traces, tolerance, b)
                if values[0] > 1e-8 * max(1.0, np.abs(a).max()):
                    raise ValueError(f"the least eigenvalue of the edges' Laplacian is {values[0]:.1e}, not 0")
            inside = vectors[np.searchsorted(v, own_)]
            targets = orthogonal_to_first(inside[:, 0], inside[:, 1:most], most)
        return _entries([(kind, ids, np.arange(block.shape[1]), block) for kind, ids, block in (("u", own_, targets), ("s", e, samples))], "k").assign(agg=key[0])

    made = rows.groupBy("g").applyInPandas(kernel, "agg long, kind string, i long, k long, v double")
    for t in large:
        made = made.unionByName(t)
    return written(made, "targets")


def _inverse_mass(system: System, par: Parameters) -> DataFrame:
    """(j, minv) of a diagonal M; what needs a dense eigenproblem raises."""
    if par.dual:
        raise ValueError("dual traces need a dense eigenproblem: raise dense_entries, or make smaller parts")
    if not algebra.is_diagonal(system.m):
        raise ValueError("M isn't diagonal: raise dense_entries, or make smaller parts")
    return system.m.groupBy(F.col("i").alias("j")).agg((1 / F.sum("v")).alias("minv"))


def _sums(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added up by `at`, which ascends."""
    out = np.zeros((size, values.shape[1]))
    if len(at):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        out[at[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _constants(system: System, mine: DataFrame) -> DataFrame:
    """(g, dof, c): the constant on own vdofs, 0 where it has no entry."""
    return mine.join(system.constant.select(F.col("i").alias("dof"), F.col("v").alias("c")), "dof", "left").select("g", "dof", F.coalesce("c", F.lit(0.0)).alias("c"))


def _beside_constant(constant: np.ndarray, inside: np.ndarray, most: int) -> np.ndarray:
    """Targets of eigenvectors' values on own vdofs. The first one is the constant, which iterations keep only as far as their
    residuals go: what is coarse has to keep it, and bubbles to have no net flow."""
    first = fix_signs(constant[:, None])[:, 0] if constant.any() else inside[:, 0]
    out = orthogonal_to_first(first, inside[:, 1:], most)
    out[:, 1:] -= np.outer(out[:, 0], out[:, 0] @ out[:, 1:])  # what rounding left, where the others are near the constant
    return out


def _task_targets(system: System, ev: DataFrame, ee: DataFrame, mine: DataFrame, par: Parameters) -> DataFrame:
    """As _large_targets(), a task for each aggregate: it holds D's entries, of which an edof of a graph has two, and a block of vectors."""
    minv = _inverse_mass(system, par)
    d = _within(system.d.join(minv, "j").withColumn("v", F.struct("v", "minv")), ev, ee, "d").select("g", "i", "j", "v.v", "v.minv")
    own = ev.join(_constants(system, mine), ["g", "dof"], "left").select("g", F.col("dof").alias("i"), F.lit(None).cast("long").alias("j"), F.col("c").alias("v"), F.lit(None).cast("double").alias("minv"))
    count, most, tolerance, below = max(par.max_vectors, par.max_traces), par.max_vectors, par.eigen_tolerance, par.spectral_tolerance

    def kernel(key, t):
        entry = t["j"].is_valid()
        of, t = t.filter(pc.invert(entry)), t.filter(entry)
        ids, first = np.unique(of["i"].to_numpy(), return_index=True)
        own_ = of["v"].is_valid().to_numpy()[first]
        const = of["v"].to_numpy()[first][own_]
        edofs, column = np.unique(t["j"].to_numpy(), return_inverse=True)
        by_column = np.argsort(column, kind="stable")
        row, column, v = np.searchsorted(ids, t["i"].to_numpy())[by_column], column[by_column], t["v"].to_numpy()[by_column][:, None]
        minv_ = t["minv"].to_numpy()[by_column][np.r_[True, column[1:] != column[:-1]]][:, None] if len(column) else np.zeros((0, 1))
        by_row = np.argsort(row, kind="stable")
        there, across, w = row[by_row], column[by_row], v[by_row]
        flux = lambda x: minv_ * _sums(v * x[row], column, len(edofs))
        product = lambda x: _sums(w * flux(x)[across], there, len(ids))
        diagonal = _sums(w * w * minv_[across], there, len(ids))[:, 0]
        values, x = eigen.lowest_in_task(product, diagonal, ids, count, tolerance)
        keep = min(count, len(ids))
        if below < 1:
            top, _ = eigen.lowest_in_task(lambda x: -product(x), diagonal, ids, 1, 1e-5, precondition=False)
            keep = min(keep, 1 + int((values[1:] < below * -top[0]).sum()))
        targets, samples = _beside_constant(const, x[own_, : min(most, keep)], most), flux(x[:, 1:keep])
        blocks = (("u", ids[own_], targets), ("s", edofs, samples))
        return pa.concat_tables(
            pa.table({"agg": np.full(b.size, key[0].as_py()), "kind": pa.repeat(kind, b.size), "i": np.repeat(i, b.shape[1]), "k": np.tile(np.arange(b.shape[1]), len(i)), "v": b.ravel()}) for kind, i, b in blocks
        )

    return own.unionByName(d).groupBy("g").applyInArrow(kernel, "agg long, kind string, i long, k long, v double")


def _large_targets(system: System, ev: DataFrame, ee: DataFrame, mine: DataFrame, par: Parameters) -> DataFrame:
    """The rows of vertex_targets() of aggregates whose eigenproblem isn't made dense: ev, ee and mine (g, dof) are their vdofs and edofs
    with the neighbours', and their own vdofs. Own vdofs meet in a task, with max_vectors values each."""
    minv = _inverse_mass(system, par)
    d = written(_within(system.d, ev, ee, "d").join(minv, "j").select("g", "i", "j", "v", "minv"), "divergence")
    other = d.select("g", "j", F.col("i").alias("k"), F.col("v").alias("y"))
    a = written(d.join(other, ["g", "j"]).groupBy("g", "i", F.col("k").alias("j")).agg(F.sum(F.col("v") * F.col("y") * F.col("minv")).alias("v")), "laplacians")
    unknowns = ev.select("g", F.col("dof").alias("i"))
    count = max(par.max_vectors, par.max_traces)
    x, values = eigen.lowest(a, unknowns, count, par.eigen_tolerance)
    n = unknowns.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    keep = F.least(F.lit(count), F.col("n"))
    if par.spectral_tolerance < 1:
        values = values.join(eigen.largest(a, unknowns).withColumnRenamed("v", "top"), "g")
        below = F.filter(F.slice("values", 2, count), lambda y: y < par.spectral_tolerance * F.col("top"))
        keep = F.least(keep, 1 + F.size(below))  # values ascend
    keep = values.join(n, "g").select("g", keep.cast("int").alias("keep"))
    x = written(x.join(keep, "g").select("g", "i", F.expr("slice(x, 1, keep)").alias("x")), "kept")
    # one column: no samples
    each = d.join(x, ["g", "i"]).select("g", "j", "minv", "v", F.posexplode("x").alias("k", "x")).filter("k > 0")
    samples = each.groupBy("g", "j", "k").agg(F.sum(F.col("minv") * F.col("v") * F.col("x")).alias("v"))
    most = par.max_vectors

    def kernel(key, t: pd.DataFrame) -> pd.DataFrame:
        targets = _beside_constant(t["c"].to_numpy(), np.stack(t["x"].to_numpy())[:, :most], most)
        return _entries([("u", t["i"].to_numpy(), np.arange(targets.shape[1]), targets)], "k").assign(agg=key[0])

    own = _constants(system, mine).join(x.withColumnRenamed("i", "dof"), ["g", "dof"]).select("g", F.col("dof").alias("i"), "c", "x")
    targets = own.groupBy("g").applyInPandas(kernel, "agg long, kind string, i long, k long, v double")
    return targets.unionByName(samples.select(F.col("g").alias("agg"), F.lit("s").alias("kind"), F.col("j").alias("i"), (F.col("k") - 1).cast("long").alias("k"), "v"))


def face_traces(system: System, partition: DataFrame, targets: DataFrame, par: Parameters) -> DataFrame:
    """(a, b, k, i, v): the traces of each face, k = 0 the one that carries the net flow, of divergence one seen from a;
    the others carry none."""
    v, e = _placed(system, partition)
    face = e.filter("a <> b").select("a", "b").distinct()
    face = algebra.numbered(face, "g", "a", "b")
    fe = e.filter("a <> b").join(face, ["a", "b"]).select("g", F.col("edof").alias("dof"))
    sides = face.select("g", F.explode(F.array("a", "b")).alias("agg"), "a")
    ve = sides.join(v, "agg").select("g", F.col("vdof").alias("dof"), F.when(F.col("agg") == F.col("a"), 0).otherwise(1).alias("side"))
    inner = sides.join(e.filter("a = b").select(F.col("a").alias("agg"), F.col("edof").alias("dof")), "agg").select("g", "dof")
    local = inner.unionByName(fe)
    # a face's own edofs first: an aggregate has samples at most edofs of a graph with hubs, and a face with most of the others
    samples = fe.select("g", F.col("dof").alias("i")).join(sides.select("g", "agg"), "g").join(targets.filter("kind = 's'"), ["agg", "i"])
    const = ve.join(system.constant.select(F.col("i").alias("dof"), "v"), "dof")
    parts = (
        _marks(fe, "f", "dof"), _marks(local, "e", "dof"), _marks(ve, "side", "dof", v="side"), _marks(const, "c", "dof", v="v"),
        samples.withColumn("s", F.col("agg") * max(par.max_vectors, par.max_traces) + F.col("k")).transform(lambda t: _marks(t, "s", "i", "s", "v")),
        _within(system.m, local, local, "m"), _within(system.d, ve.select("g", "dof"), local, "d"),
    )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    most = par.max_traces

    def kernel(key, table: pd.DataFrame) -> pd.DataFrame:
        g = _Group(table)
        f, e_ = g.ids("f"), g.ids("e")
        side = g.rows("side").sort_values(["v", "i"])
        ids, split = side["i"].to_numpy(), int((side["v"] == 0).sum())
        order = np.argsort(ids)
        d = g.dense("d", ids[order], e_)[np.argsort(order)]
        c = g.vector("c", ids)
        at = np.searchsorted(e_, f)
        flow = c[:split] @ d[:split][:, at]  # divergence of each face edof, seen from a
        if len(f) == 1:
            traces = np.ones((1, 1))
        else:
            m = g.mass("m", e_)
            sigma, _ = saddle_solve(m, d, np.zeros((len(e_), 1)), one_minus_one(c, split)[:, None])
            s = g.rows("s")
            columns = np.unique(s["j"].to_numpy())
            traces = orthogonal_to_first(sigma[at, 0], g.dense("s", f, columns), most)
        scale = flow @ traces[:, 0]
        traces[:, 0] /= abs(scale)
        traces[:, 1:] -= np.outer(traces[:, 0], flow @ traces[:, 1:]) / np.sign(scale)
        i, k = np.meshgrid(np.arange(len(f)), np.arange(traces.shape[1]), indexing="ij")
        return pd.DataFrame({"g": key[0], "k": k.ravel(), "i": f[i.ravel()], "v": traces.ravel()})

    made = rows.groupBy("g").applyInPandas(kernel, "g long, k long, i long, v double")
    return written(made.join(face, "g").select("a", "b", "k", "i", "v"), "traces")


def coarsen(system: System, partition: DataFrame, par: Parameters = Parameters()) -> Coarsening:
    """One coarsening: transfer matrices and the next level's system. Aggregates and the neighbourhoods of faces are to
    be connected."""
    targets = vertex_targets(system, partition, par)
    traces = face_traces(system, partition, targets, par)
    u = targets.filter("kind = 'u'").select("agg", "k", "i", "v")
    number = written(algebra.numbered(u.select("agg", "k").distinct(), "c", "agg", "k"), "vdofs")
    pu = written(u.join(number, ["agg", "k"]).select("i", F.col("c").alias("j"), "v"), "pu")
    tn = written(algebra.numbered(traces.select("a", "b", "k").distinct(), "c", "a", "b", "k"), "edofs")
    n_traces = tn.count()
    bn = algebra.numbered(number.filter("k > 0").select("agg", "k"), "p", "agg", "k")
    bn = written(bn.select("agg", "k", (F.col("p") + n_traces).alias("c")), "bubbles")
    # extensions into aggregates
    v, e = _placed(system, partition)
    inner = e.filter("a = b").select(F.col("a").alias("g"), F.col("edof").alias("dof"))
    rim = e.filter("a <> b").select(F.explode(F.array("a", "b")).alias("g"), F.col("edof").alias("dof"))
    local, mine = inner.unionByName(rim), v.select(F.col("agg").alias("g"), F.col("vdof").alias("dof"))
    t = traces.join(tn, ["a", "b", "k"])
    t = t.select(F.explode(F.array("a", "b")).alias("g"), "i", F.col("c").alias("j"), "v")
    b = u.join(number, ["agg", "k"]).join(bn.select("agg", "k", F.col("c").alias("bubble")), ["agg", "k"]).select(F.col("agg").alias("g"), "i", F.col("bubble").alias("j"), "v")
    const = mine.join(system.constant.select(F.col("i").alias("dof"), "v"), "dof")
    parts = (
        _marks(inner, "e", "dof"), _marks(rim, "f", "dof"), _marks(mine, "v", "dof"), _marks(const, "c", "dof", v="v"),
        _marks(t, "t", "i", "j", "v"), _marks(b, "b", "i", "j", "v"), _within(system.m, local, local, "m"), _within(system.d, mine, local, "d"),
    )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def kernel(key, table: pd.DataFrame) -> pd.DataFrame:
        g = _Group(table)
        e_, f, v_ = g.ids("e"), g.ids("f"), g.ids("v")
        tc, bc = np.unique(g.rows("t")["j"].to_numpy()), np.unique(g.rows("b")["j"].to_numpy())
        out = []
        d = g.dense("d", v_, np.union1d(e_, f))
        cols = np.union1d(e_, f)
        bubbles = g.dense("b", v_, bc)
        if len(e_):
            m = g.mass("m", e_)
            de, df = d[:, np.searchsorted(cols, e_)], d[:, np.searchsorted(cols, f)]
            c = g.vector("c", v_)
            t_ = g.dense("t", f, tc)
            flow = df @ t_
            flow -= np.outer(c, c @ flow) / (c @ c)
            across = np.zeros((len(e_), len(tc))) if m.ndim == 1 else g.dense("m", e_, f) @ t_
            ext, _ = saddle_solve(m, de, np.column_stack([np.zeros((len(e_), len(bc))), across]), np.column_stack([bubbles, flow]))
            names = np.concatenate([bc, tc])
            out.append(("p", e_, names, ext))
        if len(bc):  # a bubble's coefficient is its target's product with the divergence
            out.append(("q", bc, cols, bubbles.T @ d))
        return _entries(out, "j")

    made = written(rows.groupBy("g").applyInPandas(kernel, "kind string, i long, j long, v double"), "extensions")
    rim_rows = traces.join(tn, ["a", "b", "k"]).select("i", F.col("c").alias("j"), (-F.col("v")).alias("v"))
    ps = written(rim_rows.unionByName(made.filter("kind = 'p'").select("i", "j", "v")).filter("v <> 0"), "ps")
    q = written(_trace_projector(system, v, e, traces.join(tn, ["a", "b", "k"])).unionByName(made.filter("kind = 'q'").select("i", "j", "v")).filter("v <> 0"), "q")
    m = written(algebra.galerkin(system.m, ps), "m")
    d = written(algebra.drop_small(algebra.chain(algebra.transpose(pu), system.d, ps), 1e-13), "d")
    w = written(algebra.galerkin(system.w, pu), "w") if system.w is not None else None
    constant = written(algebra.matvec(pu, system.constant, transposed=True), "constant")
    vdofs = number.select(F.col("c").alias("vdof"), F.col("agg").alias("vertex"))
    edofs = tn.select(F.col("c").alias("edof"), F.col("a").alias("v0"), F.col("b").alias("v1")).unionByName(bn.select(F.col("c").alias("edof"), F.col("agg").alias("v0"), F.col("agg").alias("v1")))
    return Coarsening(pu, ps, q, System(vdofs, edofs, m, d, constant, w))


def _trace_projector(system: System, v: DataFrame, e: DataFrame, traces: DataFrame) -> DataFrame:
    """Rows of Q_sigma for traces: the net flow over the first's, and a dual basis of the others."""
    first = e.filter("a <> b").select("edof", "a", "b")
    flow = system.d.join(first.select(F.col("edof").alias("j"), "a", "b"), "j").join(v.select(F.col("vdof").alias("i"), F.col("agg").alias("a")), ["i", "a"]).join(system.constant.select("i", F.col("v").alias("c")), "i")
    flow = flow.groupBy("a", "b", F.col("j").alias("i")).agg(F.sum(F.col("v") * F.col("c")).alias("v"))
    rows = traces.select("a", "b", F.lit("t").alias("kind"), "i", F.col("c").alias("j"), "v").unionByName(flow.select("a", "b", F.lit("w").alias("kind"), "i", F.lit(0).cast("long").alias("j"), "v"))

    def kernel(table: pd.DataFrame) -> pd.DataFrame:
        g = _Group(table)
        f = g.ids("t")
        names = np.unique(g.rows("t")["j"].to_numpy())
        t = -g.dense("t", f, names)
        w = g.vector("w", f)
        q = np.linalg.pinv(t)
        q[0] = w / (w @ t[:, 0])
        i, k = np.meshgrid(np.arange(len(names)), np.arange(len(f)), indexing="ij")
        return pd.DataFrame({"i": names[i.ravel()], "j": f[k.ravel()], "v": q.ravel()})

    return rows.groupBy("a", "b").applyInPandas(kernel, "i long, j long, v double")
