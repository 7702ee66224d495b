"""More named queries over whole tables: algebra, dofs, elements, partitions and grids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshgrain.operators import algebra, dofs, elements, montecarlo, nonlinear, partition, topology
from meshgrain.sources import files, grids, trade

from .catalog import EE, nation_graph, region_partition, supply, vector
from .registry import query

#: The nations' faces with their numbers, and nations in regions.
_FACES = ", ff as (select least(a, b) a0, greatest(a, b) a1, count(*)::bigint n, sum(w)::double w from ee where a <> b group by all), fn as (select row_number() over (order by a0, a1) - 1 f, * from ff), rg as (select n_nationkey::bigint n, n_regionkey::bigint r from nation)"
#: Fluxes over edges, and their ends.
_FLUX = ", sg as (select e, c u, 1 sg from ee union all select e, s, -1 from ee), fl as (select e i, (e % 5)::double v from ee)"


def _nations(spark, d):
    return trade.by_nation(spark, d)


def _part_matrix(part):
    return part.select(F.col("vertex").alias("i"), F.col("agg").alias("j"), F.lit(1.0).alias("v"))


def _flux(spark, d):
    return trade.edges(spark, d).select(F.col("edge").alias("i"), F.pmod("edge", F.lit(5)).cast("double").alias("v"))


# --- algebra


@query(EE + ", rg as (select n_nationkey::bigint n, n_regionkey::bigint r from nation) select x.r i, y.b j, sum(y.v)::double v from (select p.a a, q.a b, l.v v from lap l join ve p on p.v = l.i join ve q on q.v = l.j) y join rg x on x.n = y.a group by all")
def region_nation_product(spark, d):
    """R^T L P with different prolongations on both sides."""
    part = _nations(spark, d)
    r = _part_matrix(topology.compose(part, region_partition(spark, d)))
    return algebra.galerkin(topology.laplacian(trade.edges(spark, d)), _part_matrix(part), r)


@query("with e as (select distinct l_suppkey::bigint s, l_partkey::bigint p from lineitem) select x.s i, y.s j, sum(x.p % 5 + 1)::double v from e x join e y on x.p = y.p group by all")
def weighted_congruence(spark, d):
    """A^T D A with D over parts."""
    a = algebra.transpose(supply(spark, d))
    weight = a.select("i").distinct().select("i", (F.pmod("i", F.lit(5)) + 1).cast("double").alias("v"))
    return algebra.congruence(a, weight)


@query(EE + "select i, j, sum(v)::double v from (select i, j, 2 * v v from lap union all select c, s, -0.5 * w from ee) group by all")
def sum_of_matrices(spark, d):
    """2 L - A / 2 with A from customers to suppliers."""
    a = trade.edges(spark, d).select(F.col("v0").alias("i"), F.col("v1").alias("j"), F.col("w").alias("v"))
    return algebra.combine((2.0, topology.laplacian(trade.edges(spark, d))), (-0.5, a))


@query(EE + "select i, j, 2.5::double v from lap")
def constant_entries(spark, d):
    return algebra.constant(topology.laplacian(trade.edges(spark, d)), 2.5)


@query(EE + "select i, j from lap")
def matrix_pattern(spark, d):
    return algebra.pattern(topology.laplacian(trade.edges(spark, d)))


@query("select k + 3 i, k + 5 j, 1.0::double v from range((select least(count(*) - 3, count(*) // 2 - 5) from customer)) t(k)")
def shifted_identity(spark, d):
    n = trade.table(spark, d, "customer").count()
    return algebra.identity(spark, n, n // 2, 3, 5)


@query(EE + "select l.i, l.j, l.v from lap l join ve x on x.v = l.i join ve y on y.v = l.j where x.a = y.a")
def blocks_inside_nations(spark, d):
    return algebra.block_of(topology.laplacian(trade.edges(spark, d)), _nations(spark, d))


@query(EE + "select l.i, l.j, l.v from lap l join ve x on x.v = l.i join ve y on y.v = l.j where x.a <> y.a")
def blocks_between_nations(spark, d):
    return algebra.block_of(topology.laplacian(trade.edges(spark, d)), _nations(spark, d), inside=False)


@query(EE + """select i, j, sum(v)::double v from (select i, j, v from lap union all
select x.v, y.v, 0.25 * (x.a + 1) * (case when x.a = 3 then -1 else 1 end) * (case when y.a = 3 then -1 else 1 end) from (select a, min(v) v from ve group by a) x, (select a, min(v) v from ve group by a) y where (x.a + y.a) % 4 = 0) group by all""")
def added_block(spark, d):
    """L plus a quarter of a block over nations, at each nation's first vertex; the sign of nation 3 is turned."""
    n = trade.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    block = n.select(F.col("k").alias("i")).join(n.select(F.col("k").alias("j")), F.pmod("i", F.lit(4)) == F.pmod(-F.col("j"), F.lit(4))).withColumn("v", (F.col("i") + 1).cast("double"))
    first = _nations(spark, d).groupBy("agg").agg(F.min("vertex").alias("id"))
    at = first.select(F.col("agg").alias("pos"), F.when(F.col("agg") == 3, -1 - F.col("id")).otherwise(F.col("id")).alias("id"))
    return algebra.add_block(topology.laplacian(trade.edges(spark, d)), block, at, at, 0.25)


@query(EE + "select l.i, k j, sum(l.v * ((l.j + k) % 7))::double v from lap l, range(3) t(k) group by all")
def dense_columns(spark, d):
    """L times three columns at once."""
    x = _nations(spark, d).select(F.col("vertex").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j"))
    return algebra.multiply(topology.laplacian(trade.edges(spark, d)), x.withColumn("v", F.pmod(F.col("i") + F.col("j"), F.lit(7)).cast("double")))


@query(EE + "select k i, l.i j, sum(l.v * ((l.j + k) % 7))::double v from lap l, range(3) t(k) group by all")
def dense_columns_transposed(spark, d):
    x = _nations(spark, d).select(F.col("vertex").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j"))
    return algebra.transposed_product(topology.laplacian(trade.edges(spark, d)), x.withColumn("v", F.pmod(F.col("i") + F.col("j"), F.lit(7)).cast("double")))


@query(EE + "select l.i, l.j, 0.5 * x.v * y.v v from lap l join vec x on x.i = l.i join vec y on y.i = l.j")
def outer_on_pattern(spark, d):
    """x x^T / 2 where L has entries."""
    return algebra.outer(0.5, vector(spark, d), topology.laplacian(trade.edges(spark, d)))


@query(EE + ", cs as (select v id, row_number() over (order by v) - 1 pos from ve where a = 7) select l.i, cs.pos j, l.v from lap l join cs on cs.id = l.j")
def nation_columns(spark, d):
    """The columns of one nation, renumbered, with all rows."""
    own = algebra.numbered(_nations(spark, d).filter("agg = 7").select(F.col("vertex").alias("id")), "pos", "id")
    return algebra.pick_columns(topology.laplacian(trade.edges(spark, d)), own)


@query(EE + ", pl as (select a g, v id, row_number() over (partition by a order by v) - 1 pos from ve) select p.g, p.pos i, q.pos j, l.v from lap l join pl p on p.id = l.i join pl q on q.id = l.j and q.g = p.g")
def nation_submatrices(spark, d):
    """The Laplacian's block of every nation, each in its own numbers."""
    part = _nations(spark, d)
    start = algebra.offsets(part.groupBy("agg").agg(F.count(F.lit(1)).alias("n")), "agg", "n")
    all_ = algebra.numbered(part, "k", "agg", "vertex").join(F.broadcast(start.select("agg", "start")), "agg")
    return algebra.extract_parts(topology.laplacian(trade.edges(spark, d)), all_.select(F.col("agg").alias("g"), F.col("vertex").alias("id"), (F.col("k") - F.col("start")).alias("pos")))


@query("""with e as (select vec_id::bigint k, label, list_transform(embedding, lambda x: x::double) x from embeddings), w as (select list_transform(range(64), lambda i: (1 + i % 3)::double) w)
select a.k, b.k l, round(list_sum(list_transform(range(1, 65), lambda i: w[i] * (a.x[i] - b.x[i]) ** 2)), 4) v from e a join e b on a.label = b.label and a.k > b.k, w
union all select a.k, a.k, round(list_sum(list_transform(range(1, 65), lambda i: w[i] * a.x[i] ** 2)), 4) from e a, w""")
def weighted_distances(spark, d):
    """Squared distances in a weighted inner product, with squared norms on the diagonal."""
    e = trade.table(spark, d, "embeddings").withColumn("vec_id", F.col("vec_id").cast("long"))
    return algebra.squared_distances(e, F.col("label"), "vec_id", "embedding", [1 + i % 3 for i in range(64)], True, 4)


@query(EE + ", dg as (select v i, count(*)::double g from (select c v from ee union all select s from ee) group by v) select i, g v from dg")
def second_block(spark, d):
    """One block of a block vector: degrees, stacked under values."""
    g = topology.degrees(trade.edges(spark, d)).select(F.col("vertex").alias("i"), F.col("degree").cast("double").alias("v"))
    return algebra.block_vector(algebra.stacked(vector(spark, d), g), 1)


@query(EE + ", x0 as (select i, -v / sqrt(sum(v * v) over ()) v from vec)" + "".join(f", y{k} as (select l.i, sum(l.v * x.v) v from lap l join x{k} x on x.i = l.j group by l.i), x{k + 1} as (select i, -v / sqrt(sum(v * v) over ()) v from y{k})" for k in range(4)) + " select round((select sum(x.v * y.v) from x3 x join y3 y using (i)), 3) as value")
def power_steps(spark, d):
    """The Rayleigh quotient after four steps of power iteration on L."""
    from meshgrain.sources.checkpoints import written

    value, _ = algebra.power_iterate(written(topology.laplacian(trade.edges(spark, d))), vector(spark, d), 4, 0.0, written)
    return spark.createDataFrame([(round(value, 3),)], "value double")


@query(EE + ", z as (select i, v, v + 0.25 * (i % 3) x from vec), dz as (select sg.e, sum(sg.sg * z.v) f, sum(sg.sg * z.x) x from (select e, c u, 1 sg from ee union all select e, s, -1 from ee) sg join z on z.i = sg.u group by 1) select round(sqrt(sum((x - v) ** 2)) / sqrt(sum(v * v)), 6) vertex, round(sqrt(sum((x - v) ** 2 * (1 + i % 2))) / sqrt(sum(v * v * (1 + i % 2))), 6) weighted, (select round(sqrt(sum((x - f) ** 2)) / sqrt(sum(f * f)), 6) from dz) div from z")
def error_tuple(spark, d):
    """Plain, weighted and derivative errors of a disturbed vector."""
    x = vector(spark, d)
    y = x.select("i", (F.col("v") + 0.25 * F.pmod("i", F.lit(3))).alias("v"))
    weight = x.select("i", (1.0 + F.pmod("i", F.lit(2))).alias("v"))
    grad = algebra.transpose(topology.signed_incidence(trade.edges(spark, d)))
    one = algebra.relative_error(y, x).select(F.round("error", 6).alias("vertex"))
    two = algebra.relative_error(y, x, weight).select(F.round("error", 6).alias("weighted"))
    return one.join(two).join(algebra.divergence_error(grad, y, x).select(F.round("error", 6).alias("div")))


# --- graphs, partitions and topology


@query(EE + "select i, j, sum(w)::double v from (select c i, c j, w from ee union all select s, s, w from ee union all select c, s, w from ee union all select s, c, w from ee) group by all")
def weighted_adjacency(spark, d):
    return partition.weighted_adjacency(trade.edges(spark, d))


@query(EE + "select e edge, c v0, s v1, w from ee where c % 50 <> 0 and s % 50 <> 0")
def without_isolated(spark, d):
    """The graph that is left when some vertices are isolated before partitioning."""
    v = _nations(spark, d)
    return partition.without_vertices(trade.edges(spark, d), v, v.filter("vertex % 50 = 0"))[0].select("edge", "v0", "v1", "w")


@query(EE + ", k as (select v, row_number() over (order by v) - 1 k from ve where v % 50 = 0), t as (select max(a) + 1 t from ve), p as (select ve.v, coalesce(t + k, a) a from ve left join k on k.v = ve.v, t) select v vertex, (dense_rank() over (order by a) - 1)::bigint agg from p")
def kept_alone(spark, d):
    """Vertices alone in parts of their own, parts numbered without gaps."""
    v = _nations(spark, d)
    return partition.kept_alone(v, v.filter("vertex % 50 = 0"))


@query(EE + _FACES + " select f edge, a0 v0, a1 v1, w from fn")
def nation_graph_edges(spark, d):
    """The coarse graph: nations, with faces as edges."""
    return nation_graph(spark, d)


@query(EE + "select distinct least(a, b) agg0, greatest(a, b) agg1, c % 3 attr from ee where a <> b")
def face_attributes(spark, d):
    e = trade.edges(spark, d)
    return topology.face_attributes(e.select("edge", F.pmod("v0", F.lit(3)).alias("attr")), e, _nations(spark, d))


@query(EE + "select distinct i, j from (select a i, b j from ee union all select b, a from ee union all select a, a from ee union all select b, b from ee)")
def neighbouring_nations(spark, d):
    return topology.neighbours(trade.edges(spark, d), _nations(spark, d))


@query(EE + ", rg as (select n_nationkey::bigint n, n_regionkey::bigint r from nation) select r i, count(*)::double v from ve join rg on rg.n = ve.a group by r")
def region_sizes(spark, d):
    """Vertices in each region, from the sizes of nations."""
    return topology.sizes(region_partition(spark, d), topology.sizes(_nations(spark, d)))


@query(EE + "select e edge from ee where c % 3 = 1")
def marked_edges(spark, d):
    """Edges on a boundary attribute that is marked."""
    attr = trade.edges(spark, d).select("edge", F.pmod("v0", F.lit(3)).alias("attr"))
    return topology.marked_edges(attr, spark.createDataFrame([(1,)], "attr long"))


@query(EE + "select e edge, c v0, s v1, case when e % 2 = 0 then w else 1.0 end::double w from ee")
def default_weights(spark, d):
    """A graph from its incidence, with weights for half of its edges and one for the rest."""
    e = trade.edges(spark, d)
    return files.edges_of(topology.incidence(e), e.filter("edge % 2 = 0").select(F.col("edge").alias("i"), F.col("w").alias("v")))


@query(EE + "select e edge, least(a, b) as owner, row_number() over (order by least(a, b), e) - 1 as number from ee")
def owned_numbers(spark, d):
    """Edges numbered owner by owner."""
    return dofs.owned_numbers(topology.edge_owner(trade.edges(spark, d), _nations(spark, d)))


@query("select l_orderkey::bigint * 8 + l_linenumber entity, l_orderkey::bigint shared, min(l_orderkey::bigint * 8 + l_linenumber) over (partition by l_orderkey) as owner from lineitem")
def true_entities(spark, d):
    """Line items as entities that share their order: the least owns it."""
    t = trade.table(spark, d, "lineitem").select((F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("entity"), F.col("l_orderkey").cast("long").alias("shared"))
    return dofs.true_entities(t)


# --- degrees of freedom, mixed systems and elements


@query(EE + _FACES + """, tr as (select f id, (a0 + a1) % 2 + 1 n from fn), tg as (select a id, a % 3 n from (select distinct a from ve)),
td as (select id, n, coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0) st from tr), bd as (select id, n, coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0) + (select sum(n) from tr) st from tg),
te2 as (select id f, unnest(range(st::bigint, (st + n)::bigint)) e from td where n > 0)
select id::bigint agg, unnest(range(st::bigint, (st + n)::bigint)) edof, 2.0::double v from bd where n > 0 union all select a0, e, 1.0 from fn join te2 using (f) union all select a1, e, 1.0 from fn join te2 using (f)""")
def vertex_edofs(spark, d):
    """Edofs of nations: their bubbles, after all traces, and the traces of their faces."""
    f = nation_graph(spark, d)
    traces = f.select(F.col("edge").alias("id"), (F.pmod(F.col("v0") + F.col("v1"), F.lit(2)) + 1).alias("n"))
    targets = _nations(spark, d).select("agg").distinct().select(F.col("agg").alias("id"), (F.pmod("agg", F.lit(3)) + 1).alias("n"))
    return dofs.vertex_edofs(targets, traces, f.select(F.col("edge").alias("face"), F.explode(F.array("v0", "v1")).alias("agg")))


@query(EE + "select a agg, e edof from (select a, e from ee union all select b, e from ee) group by a, e having count(*) >= 1.5")
def interior_edofs(spark, d):
    """Edges seen twice by one nation."""
    ends = topology.aggregate_edges(trade.edges(spark, d), _nations(spark, d))
    return dofs.interior(ends.select("agg", F.col("edge").alias("edof"), F.col("ends").alias("v")))


@query(EE + "select e i from ee where c % 3 in (0, 2)")
def essential_edofs(spark, d):
    attr = trade.edges(spark, d).select(F.col("edge").alias("edof"), F.pmod("v0", F.lit(3)).alias("attr"))
    return dofs.essential(attr, spark.createDataFrame([(0,), (2,)], "attr long"))


@query(EE + _FLUX + """, mx as (select 0 block, t.i, sum(t.v) v from (select e i, fl.v / w v from ee join fl on fl.i = ee.e union all select sg.e, sg.sg * vec.v from sg join vec on vec.i = sg.u) t group by t.i)
select 0 as block, mx.i, round(case when mx.i % 7 = 0 then fl.v else mx.v end, 6) v from mx join fl using (i) union all select 1, sg.u, round(sum(sg.sg * fl.v), 6) from sg join fl on fl.i = sg.e group by sg.u""")
def mixed_matvec(spark, d):
    """[[M, D^T], [D, 0]] times a block vector, with the rows of some fixed edofs."""
    e = trade.edges(spark, d)
    m = e.select(F.col("edge").alias("i"), F.col("edge").alias("j"), (1 / F.col("w")).alias("v"))
    fixed = e.filter("edge % 7 = 0").select(F.col("edge").alias("i"))
    return dofs.block_apply(m, topology.signed_incidence(e), algebra.stacked(_flux(spark, d), vector(spark, d)), fixed).withColumn("v", F.round("v", 6))


@query(EE + ", s as (select i, v, 1.0 + i % 2 w from vec) select ve.a i, round(sum(w * s.v) / sum(w), 6) v from s join ve on ve.v = s.i group by ve.a")
def nation_averages(spark, d):
    """A vector's averages over nations, weighted by sizes."""
    x = vector(spark, d)
    return dofs.averages(x, _nations(spark, d), x.select("i", (1.0 + F.pmod("i", F.lit(2))).alias("v"))).withColumn("v", F.round("v", 6))


@query(EE + ", m as (select ve.a, avg(vec.v) m from vec join ve on ve.v = vec.i group by ve.a) select ve.v i, round(m, 6) v from ve join m using (a)")
def averages_interpolated(spark, d):
    part = _nations(spark, d)
    return dofs.piecewise_constant(dofs.averages(vector(spark, d), part), part).withColumn("v", F.round("v", 6))


@query(EE + "select c elem, e i, e j, 1 / (2 * w) v from ee union all select s, e, e, 1 / (2 * w) from ee")
def fine_elements(spark, d):
    return elements.fine_elements(trade.edges(spark, d))


@query(EE + "select e i, e j, round(1 / (2 * w * (1 + c % 3)) + 1 / (2 * w * (1 + s % 3)), 8) v from ee")
def assembled_mass(spark, d):
    """M from its elements, each divided by a coefficient."""
    c = _nations(spark, d).select(F.col("vertex").alias("i"), (1.0 + F.pmod("vertex", F.lit(3))).alias("v"))
    return elements.assemble(elements.fine_elements(trade.edges(spark, d)), c).withColumn("v", F.round("v", 8))


@query(EE + _FLUX + "select e i, round((1 / (2 * w * (1 + c % 3)) + 1 / (2 * w * (1 + s % 3))) * fl.v, 8) v from ee join fl on fl.i = ee.e")
def element_matvec(spark, d):
    """M(coefficient) x without assembling M."""
    c = _nations(spark, d).select(F.col("vertex").alias("i"), (1.0 + F.pmod("vertex", F.lit(3))).alias("v"))
    return elements.apply(elements.fine_elements(trade.edges(spark, d)), _flux(spark, d), c).withColumn("v", F.round("v", 8))


@query(EE + _FLUX + """, k as (select i, exp(0.25 * v) k from vec), t as (select e i, -fl.v * (1 / (2 * w * p.k) + 1 / (2 * w * q.k)) v from ee join fl on fl.i = ee.e join k p on p.i = ee.c join k q on q.i = ee.s union all select sg.e, -sg.sg * vec.v from sg join vec on vec.i = sg.u union all select i, 1.0 from fl)
select 0 as block, i, round(sum(v), 6) v from t group by i union all select 1, i, round(sum(v), 6) from (select sg.u i, -sg.sg * fl.v v from sg join fl on fl.i = sg.e union all select i, v % 2 from vec) group by i""")
def nonlinear_residual(spark, d):
    """The residual of the flow with k = exp(u / 4) on the trade graph."""
    e, x = trade.edges(spark, d), vector(spark, d)
    right = algebra.stacked(e.select(F.col("edge").alias("i"), F.lit(1.0).alias("v")), x.select("i", F.pmod("v", F.lit(2.0)).alias("v")))
    out = nonlinear.residual(elements.fine_elements(e), topology.signed_incidence(e), nonlinear.Conductivity(0.25), algebra.stacked(_flux(spark, d), x), right)
    return out.withColumn("v", F.round("v", 6))


@query(EE + "select i, round(exp(0.5 * v), 6) k, round(-0.5 * exp(-0.5 * v), 6) slope, round(6.0 / (2.0 + abs(v - 3) ** 1.5), 6) k2, round(1.5 * sign(v - 3) * abs(v - 3) ** 0.5 / 6.0, 6) slope2 from vec")
def conductivities(spark, d):
    """Both forms of the conductivity and the slopes of their inverses."""
    u, one, two = F.col("v"), nonlinear.Conductivity(0.5), nonlinear.Conductivity(2.0, 1.5, 3.0, 3.0)
    return vector(spark, d).select("i", *[F.round(f(k, u), 6).alias(n) for n, f, k in (("k", nonlinear.conductivity, one), ("slope", nonlinear.inverse_slope, one), ("k2", nonlinear.conductivity, two), ("slope2", nonlinear.inverse_slope, two))])


@query(EE + ", m as (select max(v) m from vec) select 1 as block, i, round(v / greatest(1.0, m * 0.75 / ln(2)), 6) v from vec, m")
def limited_step(spark, d):
    return nonlinear.limited(algebra.stacked(vector(spark, d).limit(0), vector(spark, d)), 0.75, 2.0).withColumn("v", F.round("v", 6))


# --- samples


@query("select user_id::bigint as sample, round(-sum((value - (event_id % 4)) ** 2) / 10000.0, 6) loglik, round(exp(-sum((value - (event_id % 4)) ** 2) / 10000.0), 6) lik from events group by user_id")
def likelihoods(spark, d):
    """Users as samples, their events as observations of data by place."""
    e = trade.table(spark, d, "events").select(F.col("user_id").cast("long").alias("sample"), F.pmod("event_id", F.lit(4)).cast("long").alias("place"), "value")
    data = spark.range(4).select(F.col("id").alias("place"), F.col("id").cast("double").alias("v"))
    out = montecarlo.log_likelihoods(e, data, 100.0, "sample", "place", "value")
    return out.select("sample", F.round("loglik", 6).alias("loglik"), F.round("lik", 6).alias("lik"))


@query(EE + "select i, greatest(v, 2.5) v from vec")
def floored_coefficient(spark, d):
    return montecarlo.floored(vector(spark, d), 2.5)


# --- grids whose cells are the suppliers: 10 cells in x, as many rows in y as there are


_GRID = "with n as (select (count(*) // 10)::bigint ny from supplier), g as (select c, c % 10 ix, c // 10 iy, (1.0 + c % 4)::double k from range((select ny * 10 from n)) t(c))"


def _cells(spark, d):
    size = (10, trade.table(spark, d, "supplier").count() // 10, 1)
    return grids.cells(spark, size), size


def _permeability(grid):
    k = 1.0 + F.pmod("cell", F.lit(4))
    return grid.select("cell", k.alias("kx"), (2 * k).alias("ky"), (3 * k).alias("kz"))


@query(_GRID + ", e as (select exp(-ix / 10.0) e, c from g) select g.c i, (case when ix < 5 then -1.0 else 1.0 end)::double half, (case when g.c = 0 then 1.0 when g.c = (select max(c) from g) then -1.0 else 0.0 end)::double wells, round(e.e - (select avg(e) from e), 6) wedge, coalesce(case when iy = 0 then 2.5 end, 0.0)::double inflow from g join e on e.c = g.c")
def grid_sources(spark, d):
    """Right-hand sides: half domains, corner wells, a wedge, and a flux through the low y boundary."""
    grid, size = _cells(spark, d)
    named = lambda x, n: x.select("i", F.round("v", 6).alias(n))
    out = named(grids.half_domain(grid, 10), "half").join(named(grids.corner_wells(grid, size), "wells"), "i").join(named(grids.wedge(grid, 10), "wedge"), "i")
    out = out.join(named(grids.inflow(grids.cell_faces(grid, size, 2), 3, 2.5), "inflow"), "i", "left")
    return out.withColumn("inflow", F.coalesce("inflow", F.lit(0.0)))


@query(_GRID + " select c cell, 24.0::double volume, 2.0::double z from g")
def cell_geometry(spark, d):
    return grids.geometry(_cells(spark, d)[0], (2.0, 3.0, 4.0))


@query(_GRID + ", p as (select event_id::bigint id, (event_id % 97) / 97.0 * 20 x, ((event_id // 7) % 89) / 89.0 * 3 * (select ny from n) y from events) select p.id, k kx, 2 * k ky, 3 * k kz, round(k * sqrt(14.0), 6) frobenius from p join g on g.ix = floor(x / 2) and g.iy = floor(y / 3)")
def coefficient_lookup(spark, d):
    """The coefficient at points of a slice."""
    grid, size = _cells(spark, d)
    field = grid.join(_permeability(grid), "cell")
    e = trade.table(spark, d, "events").select(F.col("event_id").cast("long").alias("id"))
    points = e.select("id", (F.pmod("id", F.lit(97)) / 97.0 * 20).alias("x"), (F.pmod(F.floor(F.col("id") / 7), F.lit(89)) / 89.0 * 3 * size[1]).alias("y"), F.lit(0.0).alias("z"))
    return grids.lookup(points, field, (2.0, 3.0, 4.0), "xy").withColumn("frobenius", F.round("frobenius", 6))


@query(_GRID + """, f as (select c, ix, iy, k, 0 ax, c c0, case when ix < 9 then c + 1 end c1, 0 odd from g union all select c, ix, iy, k, 0, c, null, 1 from g where ix = 0 union all select c, ix, iy, k, 1, c, case when iy < (select ny from n) - 1 then c + 10 end, 0 from g union all select c, ix, iy, k, 1, c, null, 1 from g where iy = 0),
b as (select c0 cell, * from f union all select c1, * from f where c1 is not null)
select b.cell, ((c0 * 2 + odd) * 3 + ax)::bigint face, round(case ax when 0 then 2.0 / (2 * g.k * 12) else 3.0 / (2 * 2 * g.k * 8) end, 8) v from b join g on g.c = b.cell""")
def finite_volume_mass(spark, d):
    grid, size = _cells(spark, d)
    return grids.finite_volume_mass(grids.cell_faces(grid, size, 2), _permeability(grid), (2.0, 3.0, 4.0)).withColumn("v", F.round("v", 8))


@query("select k edge, k v0, k + 1 v1, 1.0::double w from range((select count(*) - 1 from supplier)) t(k)")
def supplier_path(spark, d):
    """A path over as many vertices as there are suppliers."""
    return grids.path(spark, trade.table(spark, d, "supplier").count())
