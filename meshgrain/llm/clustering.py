"""Centroid clustering of integer vectors with block-norm screening.

Vectors are packed once into a table in the shared folder: their integer components, and the norm of each of SEGMENTS
segments. Between a vector x and a centroid c the squared distance is at least the sum over the segments of
(|x_s| - |c_s|)^2, by Cauchy-Schwarz, so the norms alone, an eighth of the components, give a lower bound.
Each vector is compared exactly with the centroid of least bound, and then with those whose bound doesn't exceed that
distance; all others are pruned. Distances are exact integers, ties go to the smaller number.

A round is a pass over the packed table without a shuffle: each task returns a row of sums for each cluster that
it saw, and those, k rows after adding up, are all that comes to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SEGMENTS = 8
#: Components beyond this would carry squared distances out of 64 bits.
LARGEST = 1 << 26
#: Vectors that are screened together: the bounds of a block are a table of so many rows and k columns.
BLOCK = 8192
#: What a norm may be off by rounding, of itself; bounds are lowered by more.
_SLACK = 1e-9


def packed(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: float = 64.0) -> DataFrame:
    """(id, code, norms), written: the kept vectors as little-endian 32-bit integers floor(scale * x), and the norms of
    their segments as doubles.

    Kept are vectors of exactly `dim` components, none null or not finite. Those with a component beyond LARGEST after
    scaling are left out too: their squared distances don't fit in 64 bits. Ids may repeat or be null: every row is a vector.
    """
    if dim % SEGMENTS:
        raise ValueError(f"{dim} components can't be cut in {SEGMENTS} segments")
    x = F.col(f"`{vector_col}`").cast("array<double>")
    whole = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(LARGEST) / scale))
    inner = vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))
    kind = dict(inner.dtypes)["id"]

    def pack(batches):
        for batch in batches:
            n = len(batch)
            lists = batch.column("x")
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            code = np.floor(values * scale).astype("<i4")
            norms = segment_norms(code.astype(np.int64)).astype("<f8")
            yield pa.RecordBatch.from_arrays([batch.column("id"), _binary(code, n, 4 * dim), _binary(norms, n, 8 * SEGMENTS)], names=["id", "code", "norms"])

    return written(inner.mapInArrow(pack, f"id {kind}, code binary, norms binary"), "vectors")


def _binary(rows: np.ndarray, n: int, width: int) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """The packed rows of a column as a matrix."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def first_centroids(table: DataFrame, k: int, dim: int, seed: int = 1) -> np.ndarray:
    """The k vectors of least sha256 of `seed:id`, by it; where ids repeat, by their components. A null id hashes as an empty text."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = table.select(key.alias("h"), "code").orderBy("h", "code").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r.code, "<i4") for r in rows], np.int64).reshape(len(rows), dim)


def segment_norms(c: np.ndarray) -> np.ndarray:
    return np.sqrt((c**2).reshape(len(c), SEGMENTS, c.shape[1] // SEGMENTS).sum(axis=2).astype(np.float64))


def nearest(x: np.ndarray, norms: np.ndarray, c: np.ndarray, c_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest centroid, the squared distance, and how many exact distances were worked out in all."""
    n, k = len(x), len(c)
    bound = np.zeros((n, k))
    for s in range(SEGMENTS):
        bound += (norms[:, s, None] - c_norms[None, :, s]) ** 2
    # rounding: a bound is lowered by more than it can be off
    bound -= _SLACK * ((norms**2).sum(axis=1)[:, None] + (c_norms**2).sum(axis=1)[None, :])
    who = bound.argmin(axis=1)
    best = ((x - c[who]) ** 2).sum(axis=1)
    open_ = bound <= best[:, None]
    open_[np.arange(n), who] = False
    row, col = np.nonzero(open_)
    exact = n + len(row)
    for a in range(0, len(row), 4 * BLOCK):
        r, q = row[a : a + 4 * BLOCK], col[a : a + 4 * BLOCK]
        d = ((x[r] - c[q]) ** 2).sum(axis=1)
        # the least (distance, number) of each row of this piece
        order = np.lexsort((q, d, r))
        r, q, d = r[order], q[order], d[order]
        head = np.r_[True, r[1:] != r[:-1]]
        r, q, d = r[head], q[head], d[head]
        better = (d < best[r]) | ((d == best[r]) & (q < who[r]))
        best[r[better]], who[r[better]] = d[better], q[better]
    return who, best, exact


def assign(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of packed vectors; no centroids, no rows."""
    kind = dict(table.dtypes)["id"]
    c_norms = segment_norms(centroids)

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                who, best, _ = nearest(_rows(part.column("code"), "<i4").astype(np.int64), _rows(part.column("norms"), "<f8"), centroids, c_norms)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(who.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    return (table if len(centroids) else table.limit(0)).mapInArrow(run, f"id {kind}, cluster int, distance long")


def moved(table: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The centroids after a round, each the floor of the mean of its vectors, an empty one as it was; the number of exact
    distances that were worked out, and that of all pairs."""
    dim = centroids.shape[1]
    c_norms = segment_norms(centroids)

    def sums(batches):
        total = np.zeros((len(centroids), dim), np.int64)
        count = np.zeros(len(centroids), np.int64)
        exact = 0
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                x = _rows(part.column("code"), "<i4").astype(np.int64)
                who, _, done = nearest(x, _rows(part.column("norms"), "<f8"), centroids, c_norms)
                order = np.argsort(who, kind="stable")
                there, start = np.unique(who[order], return_index=True)
                total[there] += np.add.reduceat(x[order], start, axis=0)
                count += np.bincount(who, minlength=len(count))
                exact += done
        there = np.flatnonzero(count)
        share = np.where(np.arange(len(there)) == 0, exact, 0)
        parts = [pa.array(there.astype(np.int32)), pa.array(count[there]), pa.array(share), *(pa.array(np.ascontiguousarray(total[there, j])) for j in range(dim))]
        yield pa.RecordBatch.from_arrays(parts, names=["cluster", "n", "exact", *(f"s{j}" for j in range(dim))])

    found = table.select("code", "norms").mapInArrow(sums, "cluster int, n long, exact long, " + ", ".join(f"s{j} long" for j in range(dim)))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = found.groupBy("cluster").agg(wide("n"), wide("exact"), *[wide(f"s{j}") for j in range(dim)]).collect()  # k rows
    out = centroids.copy()
    for r in rows:
        out[r.cluster] = [int(r[f"s{j}"]) // int(r.n) for j in range(dim)]
    return out, sum(int(r.exact) for r in rows), sum(int(r.n) for r in rows) * len(centroids)


def cluster(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: float = 64.0, k: int = 16, rounds: int = 3, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, cluster_inertia, inertia), a row for each kept vector, and the final centroids.

    Centroids start as first_centroids (fewer than k where fewer vectors are kept; equal ones tie, and the larger number stays empty and as
    it was). Inertias beyond 64 bits are null. Repeated rows and ids are vectors each, other columns are ignored, of any names; an
    empty table gives no rows.
    """
    table = packed(vectors, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale)
    at = first_centroids(table, k, dim, seed)
    for _ in range(rounds if len(at) else 0):
        at, _, _ = moved(table, at)
    found = written(assign(table, at), "clusters")
    own = {r.cluster: int(r.own) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}  # k rows
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    inertia = F.element_at(F.array(*[fits(own.get(j, 0)) for j in range(len(at))]), F.col("cluster") + 1) if len(at) else F.lit(None).cast("long")
    return found.select(F.col("id").alias(id_col), "cluster", "distance", inertia.alias("cluster_inertia"), fits(sum(own.values())).alias("inertia")), at


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """All vectors, 16 centroids, 3 rounds."""
    found, at = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    digest = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("cluster") + 1) if names else F.lit(None).cast("string")
    return found.withColumn("centroid_sha256", digest)
