"""Named queries over the star tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.operators import algebra, dofs, partition, topology
from meshgrain.sources import grids, trade

from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Trade edges (e, c, s, w) and with the nations of both ends (a, b).
EE = """
with te as (select o_custkey::bigint c, l_suppkey::bigint + 2147483648 s, count(*)::double w from orders join lineitem on o_orderkey = l_orderkey group by all),
     ve as (select c_custkey::bigint v, c_nationkey::bigint a from customer union all select s_suppkey::bigint + 2147483648, s_nationkey::bigint from supplier),
     ee as (select c * 2147483648 + s - 2147483648 e, c, s, w, x.a a, y.a b from te join ve x on x.v = c join ve y on y.v = s),
     lap as (select i, j, sum(v)::double v from (select c i, c j, w v from ee union all select s, s, w from ee union all select c, s, -w from ee union all select s, c, -w from ee) group by all),
     vec as (select v i, (v % 7)::double v from ve)
"""


def vector(spark: SparkSession, d: str) -> DataFrame:
    """A vector over the trade graph's vertices, of small whole numbers."""
    return trade.by_nation(spark, d).select(F.col("vertex").alias("i"), F.pmod("vertex", F.lit(7)).cast("double").alias("v"))


def supply(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and the parts they supplied, as a matrix of ones."""
    t = trade.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j")).distinct()
    return t.withColumn("v", F.lit(1.0))


@query(EE + "select least(a, b) agg0, greatest(a, b) agg1, count(*)::bigint n_edges, sum(w)::double w from ee where a <> b group by all")
def coarse_faces(spark, d):
    return topology.faces(trade.edges(spark, d), trade.by_nation(spark, d))


@query(EE + "select a agg, count(*)::bigint n, sum(w)::double w from ee where a = b group by all")
def interior_edges(spark, d):
    return topology.interior_edges(trade.edges(spark, d), trade.by_nation(spark, d))


@query(EE + "select e edge, c v0, s v1, w from ee")
def trade_edges(spark, d):
    return trade.edges(spark, d)


@query(EE + "select c vertex, e edge, 0 ord from ee union all select s, e, 1 from ee")
def incidence(spark, d):
    return topology.incidence(trade.edges(spark, d))


@query(EE + "select v vertex, count(*)::bigint degree from (select c v from ee union all select s from ee) group by all")
def degrees(spark, d):
    return topology.degrees(trade.edges(spark, d))


@query(EE + "select c i, e j, 1.0::double v from ee union all select s, e, -1.0 from ee")
def signed_incidence(spark, d):
    return topology.signed_incidence(trade.edges(spark, d))


@query(EE + "select c vertex, e edge, 2 * w w from ee union all select s, e, 2 * w from ee")
def half_weights(spark, d):
    return topology.half_weights(trade.edges(spark, d))


@query(EE + "select i, j, v from lap")
def laplacian(spark, d):
    return topology.laplacian(trade.edges(spark, d))


@query(EE + "select l.i, sum(l.v * x.v)::double v from lap l join vec x on x.i = l.j group by l.i")
def laplacian_matvec(spark, d):
    return algebra.matvec(topology.laplacian(trade.edges(spark, d)), vector(spark, d))


@query(EE + "select e i, sum(x.v * t.sg)::double v from (select e, c u, 1 sg from ee union all select e, s, -1 from ee) t join vec x on x.i = t.u group by e")
def gradient(spark, d):
    """D^T x."""
    return algebra.matvec(topology.signed_incidence(trade.edges(spark, d)), vector(spark, d), transposed=True)


@query("with e as (select distinct l_suppkey::bigint s, l_partkey::bigint p from lineitem) select x.s i, y.s j, count(*)::double v from e x join e y on x.p = y.p group by all")
def shared_parts(spark, d):
    """A A^T of the supply matrix: parts that two suppliers have in common."""
    return algebra.times_own_transpose(supply(spark, d))


@query("select distinct l_partkey::bigint i, l_suppkey::bigint j, 1.0::double v from lineitem")
def transpose(spark, d):
    return algebra.transpose(supply(spark, d))


@query(EE + "select a i, b j, sum(v)::double v from (select x.a a, y.a b, l.v v from lap l join ve x on x.v = l.i join ve y on y.v = l.j) group by all")
def galerkin_nations(spark, d):
    """P^T L P for the 0/1 matrix P of nations."""
    p = trade.by_nation(spark, d).select(F.col("vertex").alias("i"), F.col("agg").alias("j"), F.lit(1.0).alias("v"))
    return algebra.galerkin(topology.laplacian(trade.edges(spark, d)), p)


@query(EE + "select e i, e2 j, 0.0::double v from (select 0 e, 0 e2) where false union all select i, j, sum(v)::double v from (select i, j, 2 * v v from lap union all select i, i, 3 * v from vec) group by all")
def shifted_laplacian(spark, d):
    """2 L + 3 diag(x)."""
    return algebra.add_diagonal(topology.laplacian(trade.edges(spark, d)), vector(spark, d), 2.0, 3.0)


@query(EE + "select i, j, v from lap where abs(v) >= 3")
def drop_small(spark, d):
    return algebra.drop_small(topology.laplacian(trade.edges(spark, d)), 3.0)


@query(EE + ", r as (select v id, row_number() over (order by v) - 1 pos from ve where a = 7) select p.pos i, q.pos j, l.v from lap l join r p on p.id = l.i join r q on q.id = l.j")
def nation_submatrix(spark, d):
    """The rows and columns of one nation, renumbered."""
    from pyspark.sql import Window

    own = trade.by_nation(spark, d).filter("agg = 7").select(F.col("vertex").alias("id"), (F.row_number().over(Window.orderBy("vertex")) - 1).cast("long").alias("pos"))
    return algebra.extract(topology.laplacian(trade.edges(spark, d)), own, own)


@query(EE + "select count(*)::bigint nnz, max(abs(v)) max_norm, round(sqrt(sum(v * v)), 6) frobenius, max((i <> j)::int)::int off_diagonal from lap")
def matrix_statistics(spark, d):
    s = algebra.statistics(topology.laplacian(trade.edges(spark, d)))
    return s.withColumn("frobenius", F.round("frobenius", 6))


@query(EE + "select sum(x.v * l.v)::double dot from vec x join (select l.i, sum(l.v * x.v) v from lap l join vec x on x.i = l.j group by l.i) l on l.i = x.i")
def energy(spark, d):
    """x^T L x."""
    x = vector(spark, d)
    return algebra.inner(x, algebra.matvec(topology.laplacian(trade.edges(spark, d)), x))


@query(EE + "select distinct i from lap where v <> 0 and j in (select v from ve where a = 3)")
def boolean_matvec(spark, d):
    marked = trade.by_nation(spark, d).filter("agg = 3").select(F.col("vertex").alias("i"))
    return algebra.boolean_matvec(topology.laplacian(trade.edges(spark, d)), marked)


@query("select distinct l_partkey::bigint j from lineitem")
def columns_used(spark, d):
    return algebra.columns_used(supply(spark, d))


@query("with e as (select distinct l_suppkey::bigint s, l_partkey::bigint p from lineitem) select s i, list_sort(list(p)) as columns from e group by s")
def rows_as_lists(spark, d):
    return algebra.rows_as_lists(supply(spark, d))


@query("select a.vec_id::bigint k, b.vec_id::bigint l, round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2)), 4) v from embeddings a join embeddings b on a.label = b.label and a.vec_id > b.vec_id")
def squared_distances(spark, d):
    e = trade.table(spark, d, "embeddings").withColumn("vec_id", F.col("vec_id").cast("long"))
    return algebra.squared_distances(e, F.col("label"), "vec_id", "embedding", digits=4)


@query(EE + "select i, round(v - avg(v) over (), 6) v from vec")
def minus_mean(spark, d):
    return algebra.minus_mean(vector(spark, d)).withColumn("v", F.round("v", 6))


@query(EE + ", dg as (select v, count(*)::double g from (select c v from ee union all select s from ee) group by v), f as (select sum(x.v * g) / sum(g * g) f from vec x join dg on dg.v = x.i) select x.i, round(x.v - f * g, 6) v from vec x join dg on dg.v = x.i, f")
def minus_projection(spark, d):
    g = topology.degrees(trade.edges(spark, d)).select(F.col("vertex").alias("i"), F.col("degree").cast("double").alias("v"))
    return algebra.minus_projection(vector(spark, d), g).withColumn("v", F.round("v", 6))


@query(EE + "select x.i, x.v * count(*)::double v from vec x join (select c v from ee union all select s from ee) g on g.v = x.i group by x.i, x.v")
def rescaled(spark, d):
    g = topology.degrees(trade.edges(spark, d)).select(F.col("vertex").alias("i"), F.col("degree").cast("double").alias("v"))
    return algebra.rescale(vector(spark, d), g)


@query(EE + "select i, case when i in (select v from ve where a = 3) then 0.0 else v end v from vec")
def zeroed(spark, d):
    return algebra.zero_at(vector(spark, d), trade.by_nation(spark, d).filter("agg = 3").select(F.col("vertex").alias("i")))


@query(EE + "select max(abs(v)) abs_max, min(v) least from vec")
def extremes(spark, d):
    return algebra.extremes(vector(spark, d))


@query(EE + ", m as (select a, avg(x.v) m from vec x join ve on ve.v = x.i group by a) select round(sqrt(sum((m - x.v) ** 2)) / sqrt(sum(x.v * x.v)), 6) error from vec x join ve on ve.v = x.i join m using (a)")
def piecewise_constant_error(spark, d):
    """The relative error of a vector's averages over nations."""
    part, x = trade.by_nation(spark, d), vector(spark, d)
    mean = x.join(part, x.i == part.vertex).groupBy("agg").agg(F.avg("v").alias("m"))
    back = part.join(mean, "agg").select(F.col("vertex").alias("i"), F.col("m").alias("v"))
    return algebra.relative_error(back, x).select(F.round("error", 6).alias("error"))


@query(EE + "select a agg, e edge, count(*)::bigint ends from (select a, e from ee union all select b, e from ee) group by all")
def aggregate_edges(spark, d):
    return topology.aggregate_edges(trade.edges(spark, d), trade.by_nation(spark, d))


@query(EE + ", f as (select distinct least(a, b) a0, greatest(a, b) a1 from ee where a <> b), n as (select row_number() over (order by a0, a1) - 1 face, a0, a1 from f) select face::bigint face, e edge from ee join n on a0 = least(a, b) and a1 = greatest(a, b) where a <> b")
def face_edges(spark, d):
    return topology.face_edges(trade.edges(spark, d), trade.by_nation(spark, d))


@query(EE + "select distinct * from (select a agg, s vertex from ee union all select b, c from ee union all select a, v from ve)")
def extended_aggregates(spark, d):
    return topology.extended_aggregates(trade.edges(spark, d), trade.by_nation(spark, d))


@query("""select c.c_nationkey::bigint agg, (o.o_custkey % 3)::bigint attr, count(*)::bigint n_edges
from (select distinct o_custkey, l_suppkey from orders join lineitem on o_orderkey = l_orderkey) o join customer c on c.c_custkey = o.o_custkey join supplier s on s.s_suppkey = o.l_suppkey where c.c_nationkey = s.s_nationkey group by all
union all select agg, attr, n from (select 0::bigint agg, 0::bigint attr, 0::bigint n) where false""")
def boundary_faces(spark, d):
    """Faces of (nation, attribute) for the edges inside nations, with an attribute by customer."""
    e = trade.edges(spark, d)
    inside = topology.edge_aggregates(e, trade.by_nation(spark, d)).filter("a = b").select("edge", "v0", "v1", "w")
    attr = inside.select("edge", F.pmod("v0", F.lit(3)).alias("attr"))
    return topology.boundary_faces(attr, inside, trade.by_nation(spark, d))


@query(EE + ", r as (select n_nationkey::bigint n, n_regionkey::bigint r from nation) select least(x.r, y.r) agg0, greatest(x.r, y.r) agg1, count(*)::bigint n_edges, sum(w)::double w from ee join r x on x.n = a join r y on y.n = b where x.r <> y.r group by all")
def region_faces(spark, d):
    """Faces two levels up: vertices to nations to regions."""
    regions = trade.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"), F.col("n_regionkey").cast("long").alias("agg"))
    return topology.faces(trade.edges(spark, d), topology.compose(trade.by_nation(spark, d), regions))


@query(EE + "select e edge, least(a, b) as owner from ee")
def edge_owner(spark, d):
    return topology.edge_owner(trade.edges(spark, d), trade.by_nation(spark, d))


@query(EE + "select v vertex, (dense_rank() over (order by a) - 1)::bigint agg from ve where a % 3 <> 1")
def without_gaps(spark, d):
    return partition.without_gaps(trade.by_nation(spark, d).filter("agg % 3 <> 1"))


@query(EE + ", k as (select v, row_number() over (order by v) - 1 k from ve where v % 50 = 0), t as (select max(a) + 1 t from ve) select ve.v vertex, coalesce(t + k, a)::bigint agg from ve left join k on k.v = ve.v, t")
def isolated_vertices(spark, d):
    part = trade.by_nation(spark, d)
    return partition.isolate(part, part.filter("vertex % 50 = 0"))


@query(EE + "select e edge, (floor(log2(w / (select min(w) from ee))) + 1)::bigint bucket from ee")
def weight_buckets(spark, d):
    e = trade.edges(spark, d)
    least = e.agg(F.min("w").alias("least"))
    return e.join(F.broadcast(least)).select("edge", partition.weight_bucket(F.col("w"), F.col("least")).alias("bucket"))


@query("with recursive " + EE.strip()[5:] + """, n as (select c u, s v from ee where a = b union all select s, c from ee where a = b),
reach as (select v u, v l from ve union select n.v, r.l from reach r join n on n.u = r.u where r.l < n.v),
lab as (select u, min(l) l from reach group by u),
num as (select a, l, row_number() over (order by a, l) - 1 agg from (select distinct ve.a, lab.l from lab join ve on ve.v = lab.u))
select lab.u vertex, num.agg::bigint agg from lab join ve on ve.v = lab.u join num on num.a = ve.a and num.l = lab.l""")
def connected_parts(spark, d):
    """Nations split into connected parts."""
    return partition.connected_parts(trade.edges(spark, d), trade.by_nation(spark, d))


@query(EE + "select a agg, count(*)::bigint n, (coalesce(sum(count(*)) over (order by a rows between unbounded preceding and 1 preceding), 0))::bigint start from ve group by a")
def offsets(spark, d):
    return algebra.offsets(trade.by_nation(spark, d).groupBy("agg").agg(F.count(F.lit(1)).alias("n")), "agg", "n")


@query(EE + ", z as (select a id, (count(*) % 5)::bigint n from ve group by a), st as (select id, n, coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint st from z) select id, unnest(range(st, st + n)) dof from st where n > 0")
def entity_dofs(spark, d):
    sizes = trade.by_nation(spark, d).groupBy(F.col("agg").alias("id")).agg((F.count(F.lit(1)) % 5).alias("n"))
    return dofs.entity_dofs(sizes)


@query("with g as (select c, c % 6 ix, (c // 6) % 5 iy, c // 30 iz from range(120) t(c)) select c vertex, (ix // 2) + 3 * ((iy // 2) + 3 * (iz // 2)) agg from g")
def cartesian_blocks(spark, d):
    return partition.cartesian(grids.cells(spark, (6, 5, 4)), (2, 2, 2), (6, 5, 4))


@query("""with g as (select c, c % 6 ix, (c // 6) % 5 iy, c // 30 iz, 1.0 + c % 4 k from range(120) t(c)),
f as (select c c0, case when ix < 5 then c + 1 end c1, 8.0 s, 0 ax, case when ix = 5 then 2 end attr from g union all select c, null, 8.0, 0, 1 from g where ix = 0
union all select c, case when iy < 4 then c + 6 end, 2.0, 1, case when iy = 4 then 4 end from g union all select c, null, 2.0, 1, 3 from g where iy = 0
union all select c, case when iz < 3 then c + 30 end, 0.5, 2, case when iz = 3 then 6 end from g union all select c, null, 0.5, 2, 5 from g where iz = 0)
select c0 v0, c1 v1, round(case when c1 is null then s * x.k * 2 else 1 / (1 / (s * x.k * 2) + 1 / (s * y.k * 2)) end, 6)::double w, attr from f join g x on x.c = c0 left join g y on y.c = c1""")
def two_point_grid(spark, d):
    """The graph of a 6 x 5 x 4 grid of cells of 1 x 2 x 4 with its boundary faces."""
    size = (6, 5, 4)
    grid = grids.cells(spark, size)
    k = 1.0 + F.pmod("cell", F.lit(4))
    perm = grid.select("cell", *[k.alias(c) for c in ("kx", "ky", "kz")])
    return grids.two_point_weights(grids.cell_faces(grid, size), perm, (1.0, 2.0, 4.0)).select("v0", "v1", F.round("w", 6).alias("w"), "attr")


@query("select least(a, (a + d) % 1000) v0, greatest(a, (a + d) % 1000) v1 from range(1000) t(a), range(1, 21) u(d)")
def ring_lattice(spark, d):
    return grids.ring(spark, 1000, 40)


@query(EE + ", x0 as (select i, v from vec), dg as (select i, v d from lap where i = j)" + "".join(f", y{k} as (select l.i, sum(l.v * x.v) v from lap l join x{k} x on x.i = l.j group by l.i), x{k + 1} as (select x.i, x.v + 0.5 * (x.i % 3 - y.v) / d v from x{k} x join dg on dg.i = x.i join y{k} y on y.i = x.i)" for k in range(3)) + " select i, round(v, 6) v from x3")
def jacobi_steps(spark, d):
    """Three damped Jacobi steps for L x = i mod 3."""
    a, x = topology.laplacian(trade.edges(spark, d)), vector(spark, d)
    diag = a.filter("i = j").select("i", F.col("v").alias("d"))
    for _ in range(3):
        y = algebra.matvec(a, x).select("i", F.col("v").alias("y"))
        x = x.join(diag, "i").join(y, "i").select("i", (F.col("v") + 0.5 * (F.pmod("i", F.lit(3)) - F.col("y")) / F.col("d")).alias("v"))
    return x.select("i", F.round("v", 6).alias("v"))


@query("select time_bucket(interval '1 hour', ts)::timestamp::varchar as start, event_type, count(value)::bigint n, round(avg(value), 5) mean, round(var_pop(value) * count(value), 5) varsum from events group by all")
def event_statistics(spark, d):
    """Count, mean and squared deviations of events by hour and type; an extension, with a stream's form beside it."""
    from meshgrain.streaming import statistics

    s = statistics.windowed(trade.table(spark, d, "events"), "ts", "event_type", "value")
    return s.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 5).alias("mean"), F.round("varsum", 5).alias("varsum"))


# --- what SQL can't say: kernels, hierarchies and samples on the graph of nations and on grids


def nation_graph(spark: SparkSession, d: str) -> DataFrame:
    return topology.coarse_graph(trade.edges(spark, d), trade.by_nation(spark, d))


def region_partition(spark: SparkSession, d: str) -> DataFrame:
    return trade.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"), F.col("n_regionkey").cast("long").alias("agg"))


def _grid(spark: SparkSession, n: int = 12) -> tuple[DataFrame, DataFrame]:
    """An n x n grid as edges with collected numbering, and its partition into blocks of 4 x 4."""
    size = (n, n, 1)
    cells = grids.cells(spark, size)
    k = 1.0 + F.pmod("cell", F.lit(5))
    edges = grids.two_point_weights(grids.cell_faces(cells, size, 2), cells.select("cell", *[k.alias(c) for c in ("kx", "ky", "kz")]), (1.0, 1.0, 1.0))
    return grids.numbered(edges.filter("v1 is not null").select("edge", "v0", "v1", "w")), partition.cartesian(cells, (4, 4, 1), size)


@query()
def upscaled_nations(spark, d):
    """Errors of the trade graph of nations upscaled to regions, for the flow between the first nation and the last."""
    from meshgrain.operators import hierarchy, spectral

    edges = nation_graph(spark, d)
    vertices = trade.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"))
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, vertices), [region_partition(spark, d)])
    f = vertices.select(F.col("vertex").alias("i"), F.when(F.col("vertex") == 0, 1.0).when(F.col("vertex") == 24, -1.0).otherwise(0.0).alias("v"))
    return spark.createDataFrame([tuple(h.errors(1, f).values())], "vertex double, edge double, div double, complexity double")


@query()
def fiedler_nations(spark, d):
    """The second eigenvector of the graph of nations."""
    from meshgrain.operators import hierarchy

    return hierarchy.fiedler(nation_graph(spark, d))


@query()
def small_world(spark, d):
    return grids.small_world(spark, 1000, 40, 0.15, 7)


@query()
def grown_parts(spark, d):
    """Connected parts grown over the trade graph."""
    e = trade.edges(spark, d)
    v = trade.by_nation(spark, d).select("vertex")
    return partition.grow(e, v, partition.parts_for(v.count(), 64))


@query("with recursive " + EE.strip()[5:] + """, fc as (select distinct least(a, b) x, greatest(a, b) y from ee where a <> b), vs as (select v, row_number() over (order by v) k from (select x v from fc union select y from fc)),
nb as (select vs.k, list(q.k) as near from vs join (select x v, y u from fc union all select y, x from fc) e on e.v = vs.v join vs q on q.v = e.u and q.k < vs.k group by vs.k),
run as (select 0::bigint k, []::bigint[] as col union all select run.k + 1, list_append(col, list_min(list_filter(range(100), lambda c: not list_contains(list_transform(coalesce(nb.near, []::bigint[]), lambda j: col[j]), c)))) from run left join nb on nb.k = run.k + 1 where run.k < (select count(*) from vs))
select vs.v vertex, run.col[vs.k] colour from vs, (select col from run order by k desc limit 1) run""")
def face_colours(spark, d):
    """Colours for nations, different for those with a face."""
    return partition.colours(nation_graph(spark, d).select(F.col("v0").alias("i"), F.col("v1").alias("j")))


@query()
def grid_levels(spark, d):
    """A grid's hierarchy: dofs and nonzeros by level."""
    from meshgrain.operators import hierarchy, spectral

    edges, part = _grid(spark)
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, part.select("vertex")), [part], spectral.Parameters(spectral_tolerance=1.0))
    rows = [(k, s.vdofs.count(), s.edofs.count(), n) for k, (s, n) in enumerate(zip(h.systems, h.nonzeros()))]
    return spark.createDataFrame(rows, "level int, vdofs long, edofs long, nonzeros long")


@query()
def monte_carlo(spark, d):
    """Level statistics of the mean potential of a grid's left half under a random coefficient."""
    import numpy as np

    from meshgrain.operators import elements, hierarchy, montecarlo, spectral

    edges, part = _grid(spark, 8)
    w = part.select(F.col("vertex").alias("i"), F.col("vertex").alias("j"), F.lit(0.04).alias("v"))
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, part.select("vertex"), w), [part], spectral.Parameters(spectral_tolerance=1.0))
    fine = elements.fine_elements(edges)
    ls = montecarlo.levels(h, [fine, elements.coarse_elements(fine, part, h.steps[0].s)])
    free = [montecarlo.Level(**{**level.__dict__, "w": None}) for level in ls]
    left = np.arange(64) % 8 < 4
    q = montecarlo.functional(left / 64)(free)
    return montecarlo.estimate(spark, free, montecarlo.Field(ls, 1.0, 5.0, seed=1), q, np.where(left, 1.0, -1.0), first=16)[1]


def _grid_hierarchy(spark: SparkSession, n: int = 8):
    """A hierarchy of a grid with W = 0.04, its levels as arrays, and the same without W."""
    from meshgrain.operators import elements, hierarchy, montecarlo, spectral

    edges, part = _grid(spark, n)
    w = part.select(F.col("vertex").alias("i"), F.col("vertex").alias("j"), F.lit(0.04).alias("v"))
    h = hierarchy.Hierarchy.build(spectral.fine_system(edges, part.select("vertex"), w), [part], spectral.Parameters(spectral_tolerance=1.0))
    fine = elements.fine_elements(edges)
    ls = montecarlo.levels(h, [fine, elements.coarse_elements(fine, part, h.steps[0].s)])
    return h, ls, [montecarlo.Level(**{**level.__dict__, "w": None}) for level in ls]


@query()
def grid_upscaling(spark, d):
    """Errors by level of a grid's flow between two corners."""
    from meshgrain.operators import spectral
    from meshgrain.plans import drivers

    edges, part = _grid(spark)
    f = grids.corner_wells(grids.cells(spark, (12, 12, 1)), (12, 12, 1))
    return drivers.upscaling(edges, part.select("vertex"), [part], f, spectral.Parameters(spectral_tolerance=1.0))


@query()
def time_steps(spark, d):
    """Two backward Euler steps of a grid's diffusion."""
    from meshgrain.plans import drivers

    h, _, _ = _grid_hierarchy(spark)
    ids = spark.range(64).select(F.col("id").alias("i"))
    return drivers.time_steps(h.systems[0], ids.withColumn("v", (F.col("i") == 0).cast("double")), ids.withColumn("v", F.lit(1.0)), 0.5, 2)


@query()
def field_statistics(spark, d):
    """Mean and variance by aggregate of a random field's logarithm."""
    from meshgrain.operators import montecarlo
    from meshgrain.plans import drivers

    return drivers.field_statistics(spark, montecarlo.Field(_grid_hierarchy(spark)[1], 1.0, 5.0, seed=2), 1, 200)


@query()
def nonlinear_iterations(spark, d):
    """Iterations of Picard and Newton, on one level and on two."""
    import numpy as np

    from meshgrain.operators import nonlinear
    from meshgrain.plans import drivers

    return drivers.nonlinear_iterations(spark, _grid_hierarchy(spark)[2], nonlinear.Conductivity(0.5), np.where(np.arange(64) < 32, 0.2, -0.2))


@query(EE + ", r as (select n_nationkey::bigint n, n_regionkey::bigint r from nation) select 1 as level, v vertex, a agg from ve union all select 2, v, r from ve join r on r.n = ve.a")
def topology_levels(spark, d):
    """Nations and regions of all vertices."""
    from meshgrain.plans import drivers

    part = trade.by_nation(spark, d)
    return drivers.topology_levels(trade.edges(spark, d), part.select("vertex"), [part, region_partition(spark, d)])
