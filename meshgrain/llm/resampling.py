"""Importance resampling towards a target text, without replacement.

Features are runs of one to three words, hashed into buckets. Two tables of bucket counts, of all documents and of the target, give
each bucket a gain; a document's weight is the sum of its features' gains, worked out in arrays over runs of whole texts.
Weight and a Gumbel variate of the id make the score, and the highest scores are drawn:

* Runs. Each task sorts the keys of its eligible rows, (score falling, id, row), and cuts the sorted run at splitters that a
  bounded sample of keys gave; the pieces are packed into blocks and written to the shared folder.
* Ranges. The rows of each range between splitters are counted exactly, so that the place of every range in
  the whole order is known before anything is merged, as are the ranges that the draw needs at all.
* Merge. A range's blocks come to one task in the order of their first keys, which is that in which a merge asks for them, and
  a tournament tree over the runs plays out the least key each time. A block is held only while its run is in play;
  the merge ends at the last range's share of the exact count. Ranks are the range's place plus the order of coming out.

Splitters set how even the ranges are, never the result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textio import ALNUM, BATCH_ROWS, LOWER, flat, map_text, runs, sums, words

#: Keys that a task sorts at once, keys in a block, ranges at least and at most, and sampled keys for each range.
RUN_ROWS, BLOCK_ROWS, RANGES, SAMPLED = 1 << 20, 1 << 12, (256, 1 << 14), 16
#: Words up to this length are hashed side by side; longer ones by themselves.
SIDE = 63


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """The table of the checksum (the reversed polynomial 0xEDB88320), and what n bytes of 0 do to a checksum's four bytes, n from 0 to SIDE + 1."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    shift = np.empty((SIDE + 2, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SIDE + 1):
        shift[n + 1] = one[shift[n] & 255] ^ (shift[n] >> 8)
    return one, shift.reshape(-1)


_ONE, _SHIFT = _steps()
#: The checksum of a space.
_SPACE = np.uint32(zlib.crc32(b" "))


def _after(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part of a checksum that its first piece gives, when `size` more bytes follow."""
    at = size << 10
    return _SHIFT[at + (crc & 255)] ^ _SHIFT[at + 256 + ((crc >> 8) & 255)] ^ _SHIFT[at + 512 + ((crc >> 16) & 255)] ^ _SHIFT[at + 768 + (crc >> 24)]


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """CRC-32 of each word, of the two words and of the three words that end with it, joined by a space; and how many words of its text
    are before it (0, 1, or more): where there is none, or but one, the second and third have no meaning."""
    size = end - start
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -SIDE))  # words over SIDE bytes
    at, own, left = start[order[long:]], crc[order[long:]], size[order[long:]]
    for j in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -j))  # words over j bytes come first
        own[:n] = _ONE[(own[:n] ^ data[at[:n] + j]) & 255] ^ (own[:n] >> 8)
    crc[order[long:]] = ~own
    text = {int(i): data[start[i] : end[i]].tobytes() for i in order[:long]}
    for i, word in text.items():
        crc[i] = zlib.crc32(word)
    before = np.arange(len(size)) - np.repeat(first[:-1], np.diff(first))
    short = np.minimum(size, SIDE)
    tail = _after(np.full(len(size), _SPACE, np.uint32), short) ^ crc  # a space and the word
    two, three = np.zeros_like(crc), np.zeros_like(crc)
    if len(crc):
        two[1:] = _after(crc[:-1], short[1:] + 1) ^ tail[1:]
        for i, word in text.items():
            two[i] = zlib.crc32(b" " + word, int(crc[i - 1]))
        three[1:] = _after(two[:-1], short[1:] + 1) ^ tail[1:]
        for i, word in text.items():
            three[i] = zlib.crc32(b" " + word, int(two[i - 1]))
    return crc, two, three, before


def _features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of three buckets for each word, `buckets` where there is no feature; and each text's first word."""
    data, at = flat(column)
    data = LOWER[data]
    start, end, first = words(data, at, ALNUM)
    one, two, three, before = checksums(data, start, end, first)
    m = np.uint32(buckets)
    return np.stack([one % m, np.where(before > 0, two % m, m), np.where(before > 1, three % m, m)], axis=1).astype(np.int64), first


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket: a table of `buckets` rows, whatever the input."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def count(batches):
        total = np.zeros(buckets + 1, np.int64)
        for batch in batches:
            for part in runs(batch, "body"):
                total += np.bincount(_features(part.column("body"), buckets)[0].ravel(), minlength=buckets + 1)
        there = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("body")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    s_all, t_all, n = float(source.sum() + len(source)), float(target.sum() + len(target)), len(source)
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * s_all / ((float(source[b]) + 1) * t_all))) for b in range(n)], np.int64)


class Tournament:
    """A tree of matches between the leaves' keys; the least is champion. A leaf without a key loses to all."""

    def __init__(self):
        self.size, self.keys, self.won = 1, [None], [0, 0]

    def grow(self) -> None:
        self.size *= 2
        self.keys += [None] * (self.size - len(self.keys))
        self.won = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self.won[node] = self._better(self.won[2 * node], self.won[2 * node + 1])

    def _better(self, a: int, b: int) -> int:
        x, y = self.keys[a], self.keys[b]
        return a if y is None or (x is not None and x <= y) else b

    def put(self, leaf: int, key: tuple | None) -> None:
        while leaf >= self.size:
            self.grow()
        self.keys[leaf] = key
        node = (leaf + self.size) >> 1 if self.size > 1 else 0
        while node:
            self.won[node] = self._better(self.won[2 * node], self.won[2 * node + 1])
            node >>= 1

    @property
    def champion(self) -> int:
        return self.won[1] if self.size > 1 else 0


def merged(blocks, limit: int):
    """The first `limit` keys of the runs whose blocks come in the order of their first keys; blocks: (run, array of keys as rows)."""
    tree, leaf_of, held, at = Tournament(), {}, [], []
    blocks = iter(blocks)
    coming = next(blocks, None)
    while limit > 0:
        best = tree.champion
        key = tree.keys[best]
        while coming is not None and (key is None or tuple(coming[1][0]) <= key):
            run, rows = coming
            leaf = leaf_of.setdefault(run, len(leaf_of))
            if leaf == len(held):
                held.append(None)
                at.append(0)
            held[leaf], at[leaf] = rows.tolist(), 0  # its earlier block has been played out: all its keys are less than this first one
            tree.put(leaf, tuple(held[leaf][0]))
            coming = next(blocks, None)
            best = tree.champion
            key = tree.keys[best]
        if key is None:
            return
        yield key
        limit -= 1
        at[best] += 1
        if at[best] < len(held[best]):
            tree.put(best, tuple(held[best][at[best]]))
        else:
            held[best] = None
            tree.put(best, None)


def _cuts(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many of the sorted keys (rows of three numbers) are below each of the sorted splitters."""
    low = np.searchsorted(keys[:, 0], splitters[:, 0], "left")
    high = np.searchsorted(keys[:, 0], splitters[:, 0], "right")
    for i in np.flatnonzero(high > low):
        a, b = low[i], high[i]
        a, b = a + np.searchsorted(keys[a:b, 1], splitters[i, 1], "left"), a + np.searchsorted(keys[a:b, 1], splitters[i, 1], "right")
        low[i] = a + np.searchsorted(keys[a:b, 2], splitters[i, 2], "left")
    return low


def drawn(rows: DataFrame, percent: int) -> DataFrame:
    """(row, rank) of the floor(percent * N / 100) least keys among the N rows (k0, k1, row), three longs that are compared in this order;
    no two rows share `row`. Ranks begin at 1."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = rows.select(*[F.col(c).cast("long") for c in ("k0", "k1", "row")])
    n = rows.count()
    take = percent * n // 100
    none = spark.createDataFrame([], "row long, rank long")
    if not take:
        return none
    ranges = min(max(RANGES[0], n >> 20), RANGES[1])
    sample = rows.sample(min(1.0, SAMPLED * ranges / n), 7).toPandas().to_numpy(np.int64)  # at most some SAMPLED * RANGES[1] keys
    sample = sample[np.lexsort(sample.T[::-1])]
    splitters = sample[SAMPLED // 2 :: max(1, math.ceil(len(sample) / ranges))]

    def sort(batches):
        task, seq, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def cut():
            nonlocal seq
            keys = np.concatenate(parts)
            keys = keys[np.lexsort(keys.T[::-1])]
            edge = np.r_[0, _cuts(keys, splitters), len(keys)]
            out = []
            for r in np.flatnonzero(np.diff(edge)):
                for a in range(edge[r], edge[r + 1], BLOCK_ROWS):
                    block = keys[a : min(a + BLOCK_ROWS, edge[r + 1])]
                    out.append((int(r), (task << 24) + seq, *map(int, block[0]), len(block), block.tobytes()))
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), blocks)], schema=blocks)

        for batch in batches:
            parts.append(np.stack([batch.column(c).to_numpy() for c in ("k0", "k1", "row")], axis=1).astype(np.int64))
            size += len(batch)
            if size >= RUN_ROWS:
                yield cut()
                parts, size = [], 0
        if size:
            yield cut()

    blocks = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("keys", pa.binary())])
    table = written(rows.mapInArrow(sort, "range int, run long, h0 long, h1 long, h2 long, n int, keys binary"), "sorted-runs")
    before, share = 0, {}  # of each range that the draw needs: its place, and how many of its rows are drawn
    for r in table.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect():  # RANGES[1] rows at most
        if before < take:
            share[r["range"]] = (before, min(r.n, take - before))
        before += r.n

    def play(batches):
        def each():
            for batch in batches:
                for r, run, keys in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), batch.column("keys").to_pylist()):
                    yield r, run, np.frombuffer(keys, np.int64).reshape(-1, 3)

        stream = each()
        head = next(stream, None)
        while head is not None:
            now = head[0]

            def own():
                nonlocal head
                while head is not None and head[0] == now:
                    yield head[1:]
                    head = next(stream, None)

            place, limit = share[now]
            mine = own()
            got, rank = [], place
            for key in merged(mine, limit):
                got.append(key[2])
                if len(got) == RUN_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(np.arange(rank + 1, rank + 1 + len(got)))], names=["row", "rank"])
                    rank, got = rank + len(got), []
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(np.arange(rank + 1, rank + 1 + len(got)))], names=["row", "rank"])
            for _ in mine:  # what isn't drawn
                pass

    need = table.filter(F.col("range") <= max(share)).repartition("range").sortWithinPartitions("range", "h0", "h1", "h2")
    return need.select("range", "run", "keys").mapInArrow(play, "row long, rank long")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10000, least_words: int = 20, percent: int = 5, seed: int = 42
) -> DataFrame:
    """(id, n_features, weight, score, rank), a row for each document; rank is null where it isn't drawn.

    Drawn are floor(percent * N / 100) of the N documents of `least_words` words or more, by falling score; ties go to the smaller
    id, a null id comes last among equals, and equal ids in the order in which they are read. Ids are integers. A null or
    empty text has no features and weight 0. Repeated rows are documents each. Other columns are ignored, of any names; an empty
    table gives no rows, an empty target gains by the documents' counts alone.
    """
    gain = np.append(gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets)), 0)

    def make():
        def run(part: pa.RecordBatch) -> list[pa.Array]:
            where, first = _features(part.column("body"), buckets)
            n = np.diff(first)
            return [pa.array(n), pa.array(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)), pa.array(sums(gain[where].sum(axis=1), first))]

        return run

    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("body"))
    found = map_text(own, "body", ["id"], "n_words long, n_features long, weight long", make)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")
    found = written(found.select("id", F.monotonically_increasing_id().alias("row"), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scores")
    keys = found.filter(F.col("n_words") >= least_words).select((-2 * F.col("score") + F.col("id").isNull().cast("long")).alias("k0"), F.coalesce("id", F.lit(0)).alias("k1"), "row")
    out = found.join(drawn(keys, percent), "row", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op11_importance_sample(spark, sf_dir: str) -> DataFrame:
    """All documents, resampled towards the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
