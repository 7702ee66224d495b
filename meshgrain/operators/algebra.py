"""Sparse matrices and vectors as DataFrames: matrices (i, j, v), vectors (i, v).

Products are equi-joins with a sum per target entry; sums are pre-aggregated before the shuffle, and adaptive execution
splits skewed join keys. Entries that cancel stay as explicit zeros unless dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import terms
from ..sources.checkpoints import written
from ..sources.dealing import dealt, shares


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B."""
    y = b.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("v").alias("u"))
    x = a.select("i", F.col("j").alias("k"), "v")
    return x.join(y, "k").groupBy("i", "l").agg(F.sum(F.col("v") * F.col("u")).alias("v")).select("i", F.col("l").alias("j"), "v")


def chain(*factors: DataFrame) -> DataFrame:
    """The product of several matrices, from the right, so that a narrow last factor keeps the middle small."""
    out = factors[-1]
    for a in factors[-2::-1]:
        out = multiply(a, out)
    return out


def times_own_transpose(a: DataFrame) -> DataFrame:
    return gram(transpose(a))


def galerkin(a: DataFrame, p: DataFrame, r: DataFrame | None = None) -> DataFrame:
    """R^T A P; P^T A P without R."""
    return chain(transpose(r if r is not None else p), a, p)


def congruence(a: DataFrame, d: DataFrame) -> DataFrame:
    """A^T D A with D a diagonal, given as a vector."""
    return gram(a, d)


#: Entries of a row that are one list in gram().
ROW = 1024


def gram(a: DataFrame, d: DataFrame | None = None) -> DataFrame:
    """A^T A, or A^T D A: symmetric, so that only entries with i <= j are added up.

    Rows become lists of their entries, and each entry is sent to its column's place with the list, packed (terms.py): what is shuffled are
    a byte or two for a term, and a place's sums are made in one task. A long row is lists of about ROW entries, by a hash of the column,
    which meet in different tasks. Columns are whole numbers.
    """
    n = shares(a)
    x = dealt(a.select("i", "j", "v"), "i", parts=n)
    lists = x.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROW)).cast("long").alias("n"))
    if d is not None:
        lists = lists.join(dealt(d.select("i", F.col("v").alias("s")), "i", parts=n), "i")
    x = x.join(lists, "i")
    w = F.col("v") * F.col("s") if d is not None else F.col("v")
    row = x.groupBy("i", F.pmod(F.xxhash64("j"), F.col("n")).alias("b")).agg(F.first("n").alias("n"), F.collect_list(F.struct("j", w.cast("double").alias("w"), F.col("v").cast("double").alias("v"))).alias("row"))
    own, other = (F.col("row.j").alias("js"), F.col("row.w").alias("ws")), (F.col("row.j").alias("ks"), F.col("row.v").alias("vs"))
    short, long_ = row.filter("n = 1").select(*own, *other), row.filter("n > 1")
    each = long_.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"), *own)
    pairs = short.unionByName(each.join(long_.select("i", "b", *other), ["i", "b"]).drop("i", "b"))
    places = 4 * n or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = a.schema["j"].dataType

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return terms.add_up(batches, places, arrow)

    arrow = to_arrow_type(kind)
    sent = pairs.mapInArrow(lambda batches: terms.spread(batches, places), terms.BLOBS)
    return sent.repartition(places, "dest").groupBy("dest").applyInArrow(up, terms.ENTRIES.format(kind.simpleString()))


def scale_rows(a: DataFrame, d: DataFrame, inverse: bool = False) -> DataFrame:
    s = d.select("i", F.col("v").alias("s"))
    return a.join(s, "i").select("i", "j", (F.col("v") / F.col("s") if inverse else F.col("v") * F.col("s")).alias("v"))


def combine(*terms: tuple[float, DataFrame], parts: int | None = None) -> DataFrame:
    """The weighted sum of matrices or of vectors, dealt into `parts`, or as dealt() does."""
    keys = [c for c in terms[0][1].columns if c != "v"]
    weighted = [m.select(*keys, (F.lit(float(f)) * F.col("v")).alias("v")) for f, m in terms]
    out = weighted[0]
    for p in weighted[1:]:
        out = out.unionByName(p)
    return dealt(out, *keys, parts=parts).groupBy(*keys).agg(F.sum("v").alias("v"))


def add_diagonal(a: DataFrame, d: DataFrame, fa: float = 1.0, fd: float = 1.0, inverse: bool = False) -> DataFrame:
    """fa A + fd diag(d), or diag(1 / d)."""
    return combine((fa, a), (fd, diagonal(d, inverse)))


def diagonal(d: DataFrame, inverse: bool = False) -> DataFrame:
    return d.select("i", F.col("i").alias("j"), (1 / F.col("v") if inverse else F.col("v")).alias("v"))


def identity(spark: SparkSession, rows: int, columns: int | None = None, row: int = 0, column: int = 0) -> DataFrame:
    """Ones on the diagonal that starts at (row, column), as far as the shape goes."""
    n = min(rows - row, (columns if columns is not None else rows) - column)
    return spark.range(max(0, n)).select((F.col("id") + row).alias("i"), (F.col("id") + column).alias("j"), F.lit(1.0).alias("v"))


def constant(a: DataFrame, value: float) -> DataFrame:
    """The pattern of a matrix, all entries the same."""
    return a.select("i", "j", F.lit(float(value)).alias("v"))


def outer(factor: float, x: DataFrame, pattern: DataFrame) -> DataFrame:
    """factor x x^T on the entries of a pattern (i, j)."""
    u, w = x.select("i", F.col("v").alias("u")), x.select(F.col("i").alias("j"), F.col("v").alias("w"))
    return pattern.select("i", "j").join(u, "i").join(w, "j").select("i", "j", (F.lit(float(factor)) * F.col("u") * F.col("w")).alias("v"))


def pattern(a: DataFrame) -> DataFrame:
    """(i, j): where a matrix has entries."""
    return a.select("i", "j")


def transposed_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(A B)^T."""
    return multiply(transpose(b), transpose(a))


def pick_columns(a: DataFrame, columns: DataFrame) -> DataFrame:
    """All rows of the columns (id, pos), renumbered to pos."""
    return a.join(columns.select(F.col("id").alias("j"), F.col("pos").alias("to")), "j").select("i", F.col("to").alias("j"), "v")


def block_vector(x: DataFrame, block: int) -> DataFrame:
    """One block of a block vector (block, i, v)."""
    return x.filter(F.col("block") == block).select("i", "v")


def stacked(*blocks: DataFrame) -> DataFrame:
    """(block, i, v): vectors as blocks, numbered from 0."""
    out = None
    for k, x in enumerate(blocks):
        part = x.select(F.lit(k).alias("block"), "i", "v")
        out = part if out is None else out.unionByName(part)
    return out


def add_block(a: DataFrame, block: DataFrame, rows: DataFrame, columns: DataFrame, factor: float = 1.0) -> DataFrame:
    """A plus a scaled block (i, j, v), its rows and columns sent where (pos, id) say. A negative id, -1 - k, stands
    for k with the sign turned."""
    def side(t: DataFrame, name: str) -> DataFrame:
        return t.select(F.col("pos").alias(name), F.when(F.col("id") < 0, -1 - F.col("id")).otherwise(F.col("id")).alias(f"{name}_to"), F.when(F.col("id") < 0, -1.0).otherwise(1.0).alias(f"{name}_sign"))

    moved = block.join(side(rows, "i"), "i").join(side(columns, "j"), "j")
    moved = moved.select(F.col("i_to").alias("i"), F.col("j_to").alias("j"), (F.col("v") * F.col("i_sign") * F.col("j_sign")).alias("v"))
    return combine((1.0, a), (factor, moved))


def drop_small(a: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Entries of absolute value `tolerance` or more; all for a tolerance of 0 or less."""
    return a if tolerance <= 0 else a.filter(F.abs("v") >= tolerance)


def extract(a: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The submatrix of rows and columns given as (id, pos), renumbered to pos."""
    r = rows.select(F.col("id").alias("i"), F.col("pos").alias("ri"))
    c = columns.select(F.col("id").alias("j"), F.col("pos").alias("cj"))
    return a.join(r, "i").join(c, "j").select(F.col("ri").alias("i"), F.col("cj").alias("j"), "v")


def block_of(a: DataFrame, part: DataFrame, inside: bool = True) -> DataFrame:
    """The entries whose row and column are in one part of (vertex, agg), or in different ones."""
    p, q = (part.select(F.col("vertex").alias(k), F.col("agg").alias(f"part_{k}")) for k in "ij")
    both = a.join(p, "i").join(q, "j")
    return both.filter((F.col("part_i") == F.col("part_j")) == F.lit(inside)).select("i", "j", "v")


def extract_parts(a: DataFrame, places: DataFrame) -> DataFrame:
    """(g, i, j, v): of each group g the submatrix of its rows and columns, renumbered; places are (g, id, pos)."""
    r = places.select("g", F.col("id").alias("i"), F.col("pos").alias("ri"))
    c = places.select("g", F.col("id").alias("j"), F.col("pos").alias("cj"))
    return a.join(r, "i").join(c, ["g", "j"]).select("g", F.col("ri").alias("i"), F.col("cj").alias("j"), "v")


def rows_as_lists(a: DataFrame) -> DataFrame:
    """(i, columns): the columns of each row, ascending."""
    return a.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("columns"))


def columns_used(a: DataFrame) -> DataFrame:
    return a.select("j").distinct()


def statistics(a: DataFrame) -> DataFrame:
    """One row: nnz, max_norm, frobenius, is_diagonal."""
    return a.agg(
        F.count(F.lit(1)).alias("nnz"), F.max(F.abs("v")).alias("max_norm"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"),
        F.coalesce(F.max((F.col("i") != F.col("j")).cast("int")), F.lit(0)).cast("int").alias("off_diagonal"),
    )


def is_diagonal(a: DataFrame) -> bool:
    return a.filter("i <> j").isEmpty()


def matvec(a: DataFrame, x: DataFrame, transposed: bool = False, many: bool = False) -> DataFrame:
    """A x, or A^T x. Rows without entries don't appear. With `many`, each row has few entries, so that sums before the shuffle
    don't help."""
    k, to = ("i", "j") if transposed else ("j", "i")
    y = x.select(F.col("i").alias(k), F.col("v").alias("u"))
    terms = a.join(y, k).select(F.col(to).alias("i"), (F.col("v") * F.col("u")).alias("v"))
    return (dealt(terms, "i") if many else terms).groupBy("i").agg(F.sum("v").alias("v"))


def boolean_matvec(a: DataFrame, marked: DataFrame) -> DataFrame:
    """(i): rows with a nonzero entry in a marked column (i)."""
    return a.filter("v <> 0").join(marked.select(F.col("i").alias("j")).distinct(), "j", "left_semi").select("i").distinct()


def inner(u: DataFrame, v: DataFrame, w: DataFrame | None = None) -> DataFrame:
    """One row, `dot`: the sum of u v, or of w u v."""
    x = u.select("i", F.col("v").alias("x")).join(v.select("i", F.col("v").alias("y")), "i")
    p = F.col("x") * F.col("y")
    if w is not None:
        x, p = x.join(w.select("i", F.col("v").alias("w")), "i"), p * F.col("w")
    return x.agg(F.coalesce(F.sum(p), F.lit(0.0)).alias("dot"))


def extremes(x: DataFrame) -> DataFrame:
    """One row: abs_max and least of a vector."""
    return x.agg(F.max(F.abs("v")).alias("abs_max"), F.min("v").alias("least"))


def minus_mean(x: DataFrame) -> DataFrame:
    """A vector without its component along the constant one."""
    mean = x.agg(F.avg("v").alias("mean"))
    return x.join(F.broadcast(mean)).select("i", (F.col("v") - F.col("mean")).alias("v"))


def minus_projection(x: DataFrame, along: DataFrame) -> DataFrame:
    """A vector without its component along another."""
    z = x.join(along.select("i", F.col("v").alias("c")), "i")
    f = z.agg((F.sum(F.col("v") * F.col("c")) / F.sum(F.col("c") * F.col("c"))).alias("f"))
    return z.join(F.broadcast(f)).select("i", (F.col("v") - F.col("f") * F.col("c")).alias("v"))


def rescale(x: DataFrame, by: DataFrame, inverse: bool = False) -> DataFrame:
    z = x.join(by.select("i", F.col("v").alias("s")), "i")
    return z.select("i", (F.col("v") / F.col("s") if inverse else F.col("v") * F.col("s")).alias("v"))


def zero_at(x: DataFrame, marked: DataFrame) -> DataFrame:
    m = marked.select("i", F.lit(True).alias("m")).distinct()
    return x.join(m, "i", "left").select("i", F.when(F.col("m"), 0.0).otherwise(F.col("v")).alias("v"))


def relative_error(x: DataFrame, fine: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """One row, `error`: the l2 norm of x - fine over that of fine, with weights under the roots if given."""
    z = fine.select("i", F.col("v").alias("f")).join(x, "i")
    w = F.lit(1.0)
    if weight is not None:
        z, w = z.join(weight.select("i", F.col("v").alias("w")), "i"), F.col("w")
    d = F.col("v") - F.col("f")
    return z.agg((F.sqrt(F.sum(w * d * d)) / F.sqrt(F.sum(w * F.col("f") * F.col("f")))).alias("error"))


def divergence_error(d: DataFrame, x: DataFrame, fine: DataFrame) -> DataFrame:
    """One row, `error`: the norm of D (fine - x) over that of D fine."""
    return relative_error(matvec(d, x), matvec(d, fine))


#: Vectors of a block in squared_distances(), and of a strip that is compared at once; blocks that a partition of them has about.
BLOCK, STRIP, HELD = 2048, 64, 4


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded by zeros, and their lengths; -1 for a row that is null or has a null."""
    length = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    row, start = np.repeat(np.arange(len(length)), length), np.cumsum(length) - length
    out = np.zeros((len(length), max(1, int(length.max(initial=0)))))
    out[row, np.arange(len(row)) - start[row]] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    length[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    length[column.is_null().to_numpy(zero_copy_only=False)] = -1
    return out, length


def squared_distances(vectors: DataFrame, group: Column, id_col: str, array_col: str, weights: Sequence[float] | None = None, norms: bool = False, digits: int | None = None) -> DataFrame:
    """(k, l, v), k > l: the squared distances of the vectors of each group, in a weighted inner product if weights are
    given; with `norms` also k = l, the squared norms; rounded to `digits`, halves away from zero. Null where a vector is null or has a null, or lengths differ.

    The pairs are quadratic in a group's size. Vectors are dealt in blocks of about BLOCK by a hash, which are shuffled once, a row each: a
    task reads two partitions of blocks and compares those of a group two at a time. What is on disk grows with the vectors, a task's work
    is bounded, and components are added in their order.
    """
    a = vectors.select(group.alias("g"), F.col(id_col).alias("k"), F.col(array_col).alias("x"))
    count = a.filter("g is not null").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias("n"))
    at = a.filter("k is not null").join(count, "g").select("g", "k", "x", "n", F.pmod(F.xxhash64("k"), F.col("n")).alias("at"))
    blocks = count.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kind = {c: at.schema[c].dataType.simpleString() for c in ("g", "k", "x")}

    def pack(key, t):
        one = lambda c: pa.ListArray.from_arrays([0, t.num_rows], c.combine_chunks())
        x = t["x"].cast(pa.list_(t["x"].type.value_type))  # also where its elements can't be null
        return pa.table({"g": t["g"][:1], "at": t["at"][:1], "k": one(t["k"]), "x": one(x)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield from pair(*(batch[c].slice(r, 1).flatten() for c in ("ka", "xa", "kb", "xb")), batch["lo"][r] == batch["hi"][r])

    def pair(ka: pa.Array, xa: pa.Array, kb: pa.Array, xb: pa.Array, same: bool) -> Iterator[pa.RecordBatch]:
        (x, nx), (y, ny) = _matrix(xa), _matrix(xb)
        if weights is not None:
            nx[nx != len(weights)] = -1
        wide = max(x.shape[1], y.shape[1])
        x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) for z in (x, y))
        y = np.ascontiguousarray(y.T)
        left, right = ka.to_numpy(zero_copy_only=False), kb.to_numpy(zero_copy_only=False)
        for s in range(0, len(left), STRIP):
            rows = slice(s, s + STRIP)
            total = np.zeros((len(left[rows]), len(right)))
            d = np.empty_like(total)
            for c in range(wide):
                np.subtract(x[rows, c][:, None], y[c][None, :], out=d)
                np.multiply(d, d, out=d)
                if weights is not None:
                    np.multiply(d, float(weights[c]) if c < len(weights) else 0.0, out=d)
                np.add(total, d, out=total)
            k, m = left[rows][:, None], right[None, :]
            keep = k > m if same else k != m
            ok = ((nx[rows][:, None] == ny[None, :]) & (nx[rows][:, None] >= 0))[keep]
            hi, lo, v = np.maximum(k, m)[keep], np.minimum(k, m)[keep], total[keep]
            if digits is not None:
                v = np.copysign(np.floor(np.abs(v) * 10.0**digits + 0.5) / 10.0**digits, v)
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(v, mask=~ok)], ["k", "l", "v"])

    packed = at.select("g", "k", "x", "at").groupBy("g", "at").applyInArrow(pack, f"g {kind['g']}, at long, k array<{kind['k']}>, x array<{kind['x']}>")
    packed = packed.repartition(min(max(1, blocks), max(16, -(-blocks // HELD))))
    x, y = (packed.select(F.col("g").alias(f"g{s}"), F.col("at").alias(n), F.col("k").alias(f"k{s}"), F.col("x").alias(f"x{s}")) for s, n in (("a", "lo"), ("b", "hi")))
    # not by a shuffle on the group: its blocks would meet in one task
    both = x.hint("shuffle_replicate_nl").join(y, (F.col("ga") == F.col("gb")) & (F.col("lo") <= F.col("hi")))
    out = both.select("lo", "hi", "ka", "xa", "kb", "xb").mapInArrow(compare, f"k {kind['k']}, l {kind['k']}, v double")
    if norms:
        own = F.transform("x", lambda p: p.cast("double") * p.cast("double"))
        if weights is not None:
            own = F.zip_with(own, F.array(*[F.lit(float(w)) for w in weights]), lambda s, w: s * w)
        out = out.unionByName(a.select("k", F.col("k").alias("l"), F.aggregate(own, F.lit(0.0), lambda s, t: s + t).alias("v")).withColumn("v", F.col("v") if digits is None else F.round("v", digits)))
    return out


def power_iterate(a: Callable[[DataFrame], DataFrame] | DataFrame, x: DataFrame, steps: int = 1000, tolerance: float = 1e-8, cut: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[float, DataFrame]:
    """The dominant eigenvalue and vector: each step turns the sign, applies, and stops where the Rayleigh quotient's
    relative change is below the tolerance; RuntimeError if it isn't after all steps. A tolerance of 0 asks for exactly `steps` steps.
    `cut` cuts the lineage of a step's vector."""
    apply = (lambda y: matvec(a, y)) if isinstance(a, DataFrame) else a
    norm = np.sqrt(inner(x, x).first().dot)
    x, last = x.select("i", (F.col("v") / F.lit(float(norm))).alias("v")), None
    for _ in range(steps):
        x = x.select("i", (-F.col("v")).alias("v"))
        y = cut(apply(x))
        value = inner(x, y).first().dot
        norm = np.sqrt(inner(y, y).first().dot)
        x = y.select("i", (F.col("v") / F.lit(float(norm))).alias("v"))
        if last is not None and abs(value - last) < tolerance * abs(value):
            return value, x
        last = value
    if tolerance > 0:
        raise RuntimeError(f"the quotient still changes by {tolerance:.1e} or more after {steps} steps")
    return value, x


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with __p, a part that rises with the whole key, and __own, a row's place in its part; written. Spark samples the
    keys and cuts at as many places as the session's shuffle has partitions, which adaptive execution makes fewer for small tables."""
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    return written(ranged.select("*", F.spark_partition_id().alias("__p"), own.alias("__own")), "numbering")


def _starts(d: DataFrame, amount: Column) -> DataFrame:
    """What all parts before each have in sum: a row for each part, however long the table."""
    each = d.groupBy("__p").agg(amount.alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(each.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds a number from 0 without gaps in the given order of orderable columns, nulls first.

    Rows are dealt by ranges of the whole key, so that a first column of few values doesn't matter; only a table of a count for each part
    meets in one task. Rows that agree in all of the order's columns take their numbers in any order. The table is written, as numbers
    are places in its parts.
    """
    d = _ranged(df, order)
    return d.join(_starts(d, F.count(F.lit(1))), "__p").withColumn(name, (F.col("__own") + F.col("__start")).cast("long")).drop("__p", "__own", "__start")


def offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """Exclusive prefix sums in the order of a key, which occurs once each: (key, size, start). Dealt as numbered()."""
    d = _ranged(sizes.select(key, size), [key])
    own = F.coalesce(F.sum(size).over(Window.partitionBy("__p").orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("__sum", own).join(_starts(d, F.sum(size)), "__p").select(key, size, (F.col("__sum") + F.col("__start")).cast("long").alias("start"))
