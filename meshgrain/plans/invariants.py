"""Queries whose results SQL can't compute but can check: what must hold of partitions, coarse systems and solutions, a row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.operators import algebra, elements, hierarchy, multilevel, partition, spectral, topology
from meshgrain.plans import drivers
from meshgrain.sources import trade
from meshgrain.sources.checkpoints import written

from .catalog import EE, nation_graph, region_partition
from .registry import query

#: Nations with their regions, and the pairs of nations that have a face.
NR = EE + ", r as (select n_nationkey::bigint n, n_regionkey::bigint r from nation), nf as (select distinct least(a, b) a, greatest(a, b) b from ee where a <> b)"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return trade.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"))


def _worst(a: DataFrame, b: DataFrame) -> float:
    """The largest difference of two matrices' entries."""
    z = a.select("i", "j", "v").unionByName(b.select("i", "j", (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.abs(F.sum("v")).alias("v"))
    return z.agg(F.coalesce(F.max("v"), F.lit(0.0))).first()[0]


def _identity(ids: DataFrame, name: str) -> DataFrame:
    return ids.select(F.col(name).alias("i"), F.col(name).alias("j"), F.lit(1.0).alias("v"))


@query("with recursive " + EE.strip()[5:] + """, n as (select c u, s v from ee where a = b union all select s, c from ee where a = b),
reach as (select v u, v l from ve union select n.v, r.l from reach r join n on n.u = r.u where r.l < n.v),
lab as (select a, count(*)::bigint vertices, count(distinct l)::bigint pieces from (select u, min(l) l from reach group by u) x join ve on ve.v = x.u group by a),
own as (select a, sum(w) w from ee where a = b group by a), rim as (select a, sum(w) w from (select a, w from ee where a <> b union all select b, w from ee where a <> b) group by a)
select lab.a as agg, vertices, coalesce(own.w, 0)::double as inside, coalesce(rim.w, 0)::double as cut, pieces from lab left join own using (a) left join rim using (a)""")
def partition_quality(spark, d):
    """Vertices, weights inside and across, and connected pieces of each nation."""
    return multilevel.quality(trade.edges(spark, d), trade.by_nation(spark, d))


def _sound(edges: DataFrame, part: DataFrame, asked: int, balance: float) -> DataFrame:
    """One row: vertices, whether all parts are within the bound, connected, and numbered without gaps, and their cuts add up."""
    part = written(part, "parts")
    q = multilevel.quality(edges, part).agg(F.sum("vertices").alias("vertices"), F.max("vertices").alias("largest"), F.max("pieces").alias("pieces"), F.sum("cut").alias("cut"), F.sum("inside").alias("inside"))
    total = edges.agg(F.sum("w").alias("total"))
    most = F.greatest(F.lit(1), F.floor(F.lit(balance) * F.col("vertices") / asked))
    return q.join(F.broadcast(total)).select("vertices", (F.col("largest") <= most).alias("within"), (F.col("pieces") == 1).alias("connected"), (F.col("cut") / 2 + F.col("inside") == F.col("total")).alias("adds_up"))


SOUND = EE + "select count(*)::bigint as vertices, true as within, true as connected, true as adds_up from ve"


@query(SOUND)
def cut_parts(spark, d):
    """Parts of about 64 vertices with a small cut over the whole trade graph."""
    e, v = written(trade.edges(spark, d), "edges"), trade.by_nation(spark, d).select("vertex")
    asked = partition.parts_for(v.count(), 64)
    return _sound(e, multilevel.cut_parts(e, v, asked), asked, 1.5)


@query(SOUND)
def grown_parts_sound(spark, d):
    """Parts grown over the whole trade graph."""
    e, v = written(trade.edges(spark, d), "edges"), trade.by_nation(spark, d).select("vertex")
    asked = partition.parts_for(v.count(), 64)
    return _sound(e, partition.grow(e, v, asked), asked, 2.0)


@query(NR + " select least(x.r, y.r) agg0, greatest(x.r, y.r) agg1, count(*)::bigint n_edges, 1.0::double flow, 0.0::double others from nf join r x on x.n = nf.a join r y on y.n = nf.b where x.r <> y.r group by all")
def dual_traces(spark, d):
    """Faces of regions in the graph of nations: edges, the net flow of the first dual trace, and the largest of the others."""
    e, part = written(nation_graph(spark, d), "nations"), region_partition(spark, d)
    system, par = spectral.fine_system(e, _nations(spark, d)), spectral.Parameters(spectral_tolerance=1.0, dual=True)
    traces = spectral.face_traces(system, part, spectral.vertex_targets(system, part, par), par)
    side = topology.edge_aggregates(e, part).select(F.col("edge").alias("i"), F.col("a").alias("from"))
    flow = traces.join(side, "i").groupBy("a", "b", "k").agg(F.sum(F.when(F.col("from") == F.col("a"), F.col("v")).otherwise(-F.col("v"))).alias("flow"), F.count(F.lit(1)).alias("n"))
    out = flow.groupBy(F.col("a").alias("agg0"), F.col("b").alias("agg1")).agg(F.max("n").alias("n_edges"), F.max(F.when(F.col("k") == 0, F.col("flow"))).alias("flow"), F.max(F.when(F.col("k") > 0, F.abs("flow"))).alias("others"))
    return out.select("agg0", "agg1", "n_edges", F.round("flow", 8).alias("flow"), F.round(F.coalesce("others", F.lit(0.0)), 8).alias("others"))


@query(EE + """, n as (select n_nationkey::bigint n, n_regionkey::bigint r, n_nationkey in (0, 24) alone from nation),
size as (select r, count(*) filter (not alone)::bigint k, sum(count(*) filter (not alone)) over ()::bigint whole from n group by r)
select 1 as level, n as vertex, case when alone then 1 else k end::bigint as own from n join size using (r) union all select 2, n, case when alone then 1 else whole end::bigint from n join size using (r)""")
def alone_levels(spark, d):
    """Two levels over nations of which the first and the last stay alone: how many nations each one's aggregate has."""
    alone = _nations(spark, d).filter("vertex in (0, 24)")
    first = written(partition.kept_alone(region_partition(spark, d), alone), "first")
    above = first.join(alone, "vertex", "left_semi").select(F.col("agg").alias("vertex"))
    second = written(partition.kept_alone(first.select(F.col("agg").alias("vertex"), F.lit(0).cast("long").alias("agg")).distinct(), above), "second")
    levels = written(drivers.topology_levels(nation_graph(spark, d), _nations(spark, d), [first, second]), "levels")
    sizes = levels.groupBy("level", "agg").agg(F.count(F.lit(1)).alias("own"))
    return levels.join(sizes, ["level", "agg"]).select("level", "vertex", "own")


@query("select * from (values ('coarse M is the sum of its elements', true), ('D is the product of its factors', true), ('M for another coefficient is that of the fine one', true), ('Q inverts P on fluxes', true), ('targets are orthonormal', true)) t(identity, holds)")
def coarse_identities(spark, d):
    """What holds of the graph of nations, coarsened to regions with dual traces."""
    e, part = written(nation_graph(spark, d), "nations"), region_partition(spark, d)
    system = spectral.fine_system(e, _nations(spark, d))
    h = hierarchy.Hierarchy.build(system, [part], spectral.Parameters(spectral_tolerance=1.0, dual=True), elements=elements.fine_elements(e))
    c, top = h.steps[0], h.systems[1]
    k = part.select(F.col("agg").alias("i"), (1.0 + F.col("agg")).alias("v")).distinct()
    fine = part.select(F.col("vertex").alias("i"), (1.0 + F.col("agg")).alias("v"))
    rows = [
        ("coarse M is the sum of its elements", _worst(elements.assemble(h.elements[1]), top.m)),
        ("D is the product of its factors", _worst(algebra.chain(algebra.transpose(c.u), system.d, c.s), top.d)),
        ("M for another coefficient is that of the fine one", _worst(h.rescaled(1, k).m, algebra.galerkin(h.rescaled(0, fine).m, c.s))),
        ("Q inverts P on fluxes", _worst(algebra.multiply(c.q, c.s), _identity(top.edofs, "edof"))),
        ("targets are orthonormal", _worst(algebra.multiply(algebra.transpose(c.u), c.u), _identity(top.vdofs, "vdof"))),
    ]
    return spark.createDataFrame([(name, worst < 1e-8) for name, worst in rows], "identity string, holds boolean")


@query(NR + " select count(*)::bigint vertices, true unit, true no_mean, true eigen from (select a from nf union select b from nf)")
def fiedler_sound(spark, d):
    """The second eigenvector of the graph of nations has length one, no mean, and no residual."""
    e = written(nation_graph(spark, d), "nations")
    x = written(hierarchy.fiedler(e), "fiedler")
    y = algebra.matvec(topology.laplacian(e), x).select("i", F.col("v").alias("y"))
    z = x.join(y, "i").agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("y")).alias("vy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    near = lambda a, b: F.abs(a - b) < 1e-8
    return z.select("vertices", near(F.col("vv"), F.lit(1.0)).alias("unit"), near(F.col("s"), F.lit(0.0)).alias("no_mean"), (F.col("yy") - F.col("vy") * F.col("vy") <= 1e-8 * F.col("yy")).alias("eigen"))


@query(EE + ", c as (select count(*) filter (v < 2147483648)::double n from ve) select s as step, n as mass from c, (values (0), (1), (2)) t(s)")
def diffusion_mass(spark, d):
    """Customers by nation, spread over the graph of nations in two implicit steps: none are lost."""
    v = written(_nations(spark, d), "vertices")
    count = trade.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    u = v.select(F.col("vertex").alias("i")).join(count, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
    system = spectral.fine_system(nation_graph(spark, d), v)
    steps = drivers.time_steps(system, written(u, "start"), v.select(F.col("vertex").alias("i"), F.lit(1.0).alias("v")), 1e-3, 2)
    return steps.groupBy("step").agg(F.round(F.sum("v"), 6).alias("mass"))


@query("select * from (values ('D is the product of its factors', true), ('M is the product of its factors', true), ('Q inverts P on fluxes', true), ('targets are orthonormal', true), ('the constant is kept', true)) t(identity, holds)")
def trade_coarsening(spark, d):
    """What holds of the whole trade graph (vertices with an edge), coarsened spectrally to parts of about 400 vertices with a small cut. A
    part with its neighbours is most of the graph: eigenvectors come over tables."""
    e, v = written(trade.edges(spark, d), "edges"), written(trade.by_nation(spark, d).select("vertex"), "vertices")
    v = written(v.join(topology.incidence(e).select("vertex").distinct(), "vertex", "left_semi"), "vertices")
    part = written(multilevel.cut_parts(e, v, partition.parts_for(v.count(), 400)), "parts")
    system = spectral.fine_system(e, v)
    c = spectral.coarsen(system, part, spectral.Parameters(spectral_tolerance=1.0, max_vectors=2, max_traces=2, dense_entries=1 << 20, eigen_tolerance=1e-4))
    top = c.coarse
    back = algebra.combine((1.0, algebra.matvec(c.u, top.constant)), (-1.0, system.constant)).agg(F.max(F.abs("v"))).first()[0]
    rows = [
        ("D is the product of its factors", _worst(algebra.chain(algebra.transpose(c.u), system.d, c.s), top.d)),
        ("M is the product of its factors", _worst(algebra.galerkin(system.m, c.s), top.m)),
        ("Q inverts P on fluxes", _worst(algebra.multiply(c.q, c.s), _identity(top.edofs, "edof"))),
        ("targets are orthonormal", _worst(algebra.multiply(algebra.transpose(c.u), c.u), _identity(top.vdofs, "vdof"))),
        ("the constant is kept", back),
    ]
    return spark.createDataFrame([(name, worst < 1e-8) for name, worst in rows], "identity string, holds boolean")
