"""N-gram Jaccard join with set-relation skipping.

Sets: the distinct `width`-word shingles of whole texts. Two sets link when their Jaccard similarity is `percent` / 100
or more. Equal sets are one class from the start. The join goes in steps:

1. Index. Every set's shingles go to index lists, dealt over hash buckets in packed blocks of a run of documents. A
   shingle in one set alone can't contribute to a match: only those of two sets or more come back, with their
   frequency. A set that keeps less than `percent` of its shingles has no partner and is done.
2. Relations between sets. Sets that share a minimum hash are compared with a few leaders of their group; links that
   hold are answers, and their components are taken. Two sets of one component need no comparison any more: the
   answers of the one are derived from those of the other. Where a group still has several components, the overlaps
   of its sets are counted list by list, in pairs of blocks of bounded size, and its sets are done with each other.
3. Lists. The rarest shingles of each set (its prefix, over all its shingles in the order of frequency) form the index
   lists. In a list, entries stand in the order of set size and in blocks; for a block, all blocks are skipped whose
   sizes or positions rule out a match, or that hold the same component only; what is left, and wasn't compared in
   step 2, are candidate pairs.
4. Candidates of different components are compared; links are added, and the components taken again.

Shingles are 64-bit hashes of whole word sequences; 48 bits of them, and their bucket, are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, grown
from .shared import written
from .textio import BATCH_ROWS, LOWER, NOT_SPACE, Rolling, flat, mix, runs, sums, words

_U = np.uint64
#: Text bytes in a run of documents whose postings are packed together, and for each bucket of the index.
PACK_BYTES = 8 << 20
#: Sets of a group that are compared with its leaders in one task, and the number of leaders.
BLOCK = 1024
LEADERS = 24
#: Minimum hashes by which sets are grouped.
MINIMA = 4


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of the whole text if that has fewer words, none without words."""
    data, at = flat(column)
    data = LOWER[data]
    start, end, first = words(data, at, NOT_SPACE)
    h = Rolling(data).ranges(start, end)
    odd = [_U(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)) for k in range(width)]
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, _U)
    for k in range(width):
        s += h[k : k + m] * odd[k]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([sum(int(x) * int(o) for x, o in zip(h[a:b], odd)) + b - a & 0xFFFFFFFFFFFFFFFF], _U)))
        else:
            out.append(h[:0])
    return out


def signature(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return np.array([mix(s).sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)]).tobytes() + len(s).to_bytes(4, "big")


_POSTING = "key long, blob long, dense boolean, high binary, low binary, who binary, ids array<string>, owner array<int>, sig binary"
_SHARED = "blob long, who binary, shingle binary, df binary, ids array<string>, owner array<int>, sig binary"
_SETS = "id string, n long, sig binary, shingle array<long>, df array<int>"


def _post(batches, width: int, buckets: int):
    """Packs each run's postings by bucket; equal sets of a run are packed once. A further row describes the run."""
    blob = (TaskContext.get().partitionId() << 24) - 1
    names = [x.split()[0] for x in _POSTING.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
    for batch in batches:
        for part in runs(batch, "body", PACK_BYTES):
            blob += 1
            seen: dict[bytes, int] = {}
            kept, own = [], []
            for s in (s for piece in runs(part, "body") for s in shingles(piece.column("body"), width)):
                g = signature(s)
                if g not in seen:
                    seen[g] = len(kept)
                    kept.append(s)
                own.append(seen[g])
            n = np.array([len(s) for s in kept])
            all_ = np.concatenate(kept) if kept else np.zeros(0, _U)
            who = np.repeat(np.arange(len(kept), dtype=np.uint16), n)
            bucket = (all_ % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            all_, who, bucket = all_[order], who[order], bucket[order]
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            rows = [(-blob - 1, blob, None, None, None, None, part.column("id").to_pylist(), own, b"".join(seen))]
            for a, b in zip(heads, np.append(heads[1:], len(bucket)) if len(heads) else []):
                v, w = all_[a:b], who[a:b]
                dense = b - a > len(kept)
                rows.append((int(bucket[a]), blob, bool(dense), (v >> _U(32)).astype(np.uint32).tobytes(), (v >> _U(16)).astype(np.uint16).tobytes(), np.bincount(w, minlength=len(kept)).astype(np.uint16 if n.max() < 1 << 16 else np.uint32).tobytes() if dense else w.tobytes(), None, None, n.max().astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _share(table: pa.Table) -> pa.Table:
    """Of a bucket's postings, those whose shingle is in two sets or more."""
    if table.column("high")[0].as_py() is None:
        empty = pa.array([None] * len(table), pa.binary())
        cols = [table.column("blob"), empty, empty, empty, table.column("ids"), table.column("owner"), table.column("sig")]
    else:
        key = table.column("key")[0].as_py()
        high, low, who, size = [], [], [], []
        for h, x, w, d, most in zip(*(table.column(c).to_pylist() for c in ("high", "low", "who", "dense", "sig"))):
            high.append(np.frombuffer(h, np.uint32))
            low.append(np.frombuffer(x, np.uint16))
            if d:
                c = np.frombuffer(w, np.uint16 if int.from_bytes(most, "little") < 1 << 16 else np.uint32)
                who.append(np.repeat(np.arange(len(c), dtype=np.uint16), c))
            else:
                who.append(np.frombuffer(w, np.uint16))
            size.append(len(high[-1]))
        value = (np.concatenate(high).astype(_U) << _U(16)) | np.concatenate(low)
        who = np.concatenate(who)
        order = np.argsort(value)
        v = value[order]
        head = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        count = np.diff(np.append(head, len(v)))
        df = np.empty(len(v), np.uint32)
        df[order] = np.repeat(count, count)
        out = []
        at = 0
        for b, n in zip(table.column("blob").to_pylist(), size):
            shared = np.flatnonzero(df[at : at + n] > 1) + at
            if len(shared):
                out.append((b, who[shared].tobytes(), mix(mix(value[shared]) + _U(key)).tobytes(), df[shared].tobytes()))
            at += n
        none = [None] * len(out)
        cols = [pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3)), pa.array(none, pa.list_(pa.string())), pa.array(none, pa.list_(pa.int32())), pa.array(none, pa.binary())]
    return pa.Table.from_arrays(cols, names=[x.split()[0] for x in _SHARED.split(", ")])


def _gather(table: pa.Table, percent: int) -> pa.Table:
    """A run's documents: id, set size, signature; the shared shingles by frequency once for each set that may have a partner."""
    who, shingle, df, meta = [], [], [], None
    for r in table.to_pylist():
        if r["sig"] is not None:
            meta = r
        else:
            who.append(np.frombuffer(r["who"], np.uint16))
            shingle.append(np.frombuffer(r["shingle"], np.int64))
            df.append(np.frombuffer(r["df"], np.int32))
    sigs = [meta["sig"][i : i + 20] for i in range(0, len(meta["sig"]), 20)]
    n = np.array([int.from_bytes(s[16:], "big") for s in sigs])
    found: dict[int, tuple] = {}
    if who:
        who, shingle, df = map(np.concatenate, (who, shingle, df))
        order = np.lexsort((shingle, df, who))
        who, shingle, df = who[order], shingle[order], df[order]
        at = np.searchsorted(who, np.arange(len(n) + 1))
        for i in np.flatnonzero((100 * np.diff(at) >= percent * n) & (n > 0)).tolist():
            found[i] = (shingle[at[i] : at[i + 1]], df[at[i] : at[i + 1]])
    rows = [(d, int(n[o]), sigs[o], *found.pop(o, (None, None))) for d, o in zip(meta["ids"], meta["owner"])]
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _SETS.split(", ")])


def _alike(x: np.ndarray, nx: int, y: np.ndarray, ny: int, percent: int) -> bool:
    """x and y: sorted shared shingles; nx and ny: sizes with the unshared."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (nx + ny - both)


def _lead(table: pa.Table, percent: int) -> pa.Table:
    """Links between the sets of a group and its leaders. What a link connects already isn't compared again."""
    sig, n = table.column("sig").to_pylist(), table.column("n").to_pylist()
    at = table.column("shingle").combine_chunks()
    # the most central sets lead: those whose shingles are the commonest in the group
    _, inverse, often = np.unique(at.flatten().to_numpy(), return_inverse=True, return_counts=True)
    cut = np.r_[0, np.cumsum([len(x) for x in at])]
    central = sums(often[inverse], cut) / np.array(n)
    order = sorted(range(len(sig)), key=lambda i: (-central[i], sig[i]))
    leaders: list[tuple[int, np.ndarray]] = []
    root = list(range(len(sig)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    links = []
    for i in order:
        own = np.sort(at[i].values.to_numpy())
        for k, (j, other) in enumerate(leaders):
            if find(i) != find(j) and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j]) and _alike(own, n[i], other, n[j], percent):
                links.append((sig[i], sig[j]))
                root[find(i)] = find(j)
                if k > 8:
                    leaders.insert(0, leaders.pop(k))
        if root[i] == i and len(leaders) < LEADERS:
            leaders.append((i, own))
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Links between the components of a group, of one block or of one with another: the overlaps of a set with all
    others are counted along the group's lists of its shingles."""
    sig, comp = table.column("sig").to_pylist(), table.column("comp").to_pylist()
    n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
    at = table.column("shingle").combine_chunks()
    cut = np.r_[0, np.cumsum([len(x) for x in at])]
    code = np.unique(at.flatten().to_numpy(), return_inverse=True)[1]
    owner_ = np.repeat(np.arange(len(n)), np.diff(cut))
    order = np.argsort(code, kind="stable")
    lists, heads = owner_[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    label = np.unique(np.array(comp, object), return_inverse=True)[1]
    size = np.bincount(label)
    across = block.min() != block.max()
    links = []
    for i in np.flatnonzero(label != size.argmax()).tolist():
        c = code[cut[i] : cut[i + 1]]
        length = heads[c + 1] - heads[c]
        both = np.bincount(lists[np.arange(length.sum()) + np.repeat(heads[c] - np.cumsum(length) + length, length)], minlength=len(n))
        ok = (label != label[i]) & (100 * both >= percent * (n + n[i] - both))
        if across:
            ok &= block != block[i]
        while ok.any():  # one link joins the components
            j = int(ok.argmax())
            links.append((sig[i], sig[j]))
            label[label == label[j]] = label[i]
            ok &= label != label[i]
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def _scan(table: pa.Table, percent: int, step: int = 64) -> pa.Table:
    """Candidate pairs of an index list: of different components and groups, by size and position. Blocks that can't
    match are skipped."""
    met = np.array(table.column("met").to_pylist(), np.int64)
    sig, comp = table.column("sig").to_pylist(), table.column("comp").to_pylist()
    n, pos = table.column("n").to_numpy(), table.column("pos").to_numpy()
    order = np.lexsort((pos, n))
    n, pos, met = n[order], pos[order], met[order]
    label = np.unique(np.array([comp[i] for i in order], object), return_inverse=True)[1]
    out_a, out_b = [], []
    heads = np.arange(0, len(n), step)
    low, high = n[heads], n[np.minimum(heads + step, len(n)) - 1]
    rest = np.maximum.reduceat(n - pos, heads)  # shingles from the list's on, at most
    done = np.minimum.reduceat(label, heads), np.maximum.reduceat(label, heads)
    need = lambda a, b: (percent * (a + b) + 100 + percent - 1) // (100 + percent)
    before = np.maximum.reduceat(pos, heads)
    for j, h in enumerate(heads):
        possible = (100 * high[: j + 1] >= percent * low[j]) & (np.minimum(before[: j + 1], before[j]) + np.minimum(rest[: j + 1], rest[j]) >= need(low[: j + 1], low[j]))
        possible &= ~((done[0][: j + 1] == done[1][: j + 1]) & (done[0][j] == done[1][j]) & (done[0][: j + 1] == done[0][j]))
        y = np.arange(h, min(h + step, len(n)))
        for i in np.flatnonzero(possible):
            x = np.arange(heads[i], min(heads[i] + step, len(n)))
            xx, yy = x[:, None], y[None, :]
            ok = (xx < yy) & (label[xx] != label[yy]) & (100 * n[xx] >= percent * n[yy])
            ok &= np.minimum(pos[xx], pos[yy]) + np.minimum(n[xx] - pos[xx], n[yy] - pos[yy]) >= need(n[xx], n[yy])
            a, b = np.nonzero(ok)
            new = (met[x[a]] != met[y[b]]).all(1)
            a, b = a[new], b[new]
            out_a.append(x[a])
            out_b.append(y[b])
    a = order[np.concatenate(out_a)] if out_a else []
    b = order[np.concatenate(out_b)] if out_b else []
    pairs = [(sig[i], sig[j]) if sig[i] < sig[j] else (sig[j], sig[i]) for i, j in zip(a, b)]
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([y for _, y in pairs], pa.binary())})


def sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Step 1: (id as string, n, sig, shingle, df) for every document, written to the shared folder."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS * 8)
    volume = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(16, math.ceil(volume / PACK_BYTES))
    inner = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("body"))
    posted = inner.mapInArrow(lambda it: _post(it, width, buckets), _POSTING)
    shared = posted.groupBy("key").applyInArrow(_share, _SHARED)
    return written(shared.groupBy("blob").applyInArrow(lambda t: _gather(t, percent), _SETS), "sets")


def _minimum(column: str, k: int) -> F.Column:
    """The k-th minimum hash of a set. The lambda takes one argument: a second would be the element's place."""
    return F.array_min(F.transform(column, lambda s: F.xxhash64(s, F.lit(k))))


def _verify(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    x = found.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("shingle").alias("sa"))
    y = found.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("shingle").alias("sb"))

    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(x, "a").join(y, "b").filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _labelled(sigs: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, comp): every set with its component, itself if it has no link."""
    comps = components(links).select(F.col("vertex").alias("sig"), "component")
    return sigs.join(comps, "sig", "left").select("sig", F.coalesce("component", "sig").alias("comp"))


def _joined(docs: DataFrame, *, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, links, own, more): join()'s members; the links of step 2, and own (sig, comp), the components of every set
    that may have a partner by these; and the links of step 4."""
    table = sets(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    found = written(table.filter("shingle is not null").dropDuplicates(["sig"]).select("sig", "n", "shingle"), "survivors")
    salted = [_minimum("shingle", k) for k in range(MINIMA)]
    minima = found.select("sig", *[m.alias(f"m{k}") for k, m in enumerate(salted)])
    keyed = minima.select("sig", F.posexplode(F.array(*[f"m{k}" for k in range(MINIMA)])).alias("k", "min"))
    many = keyed.groupBy("k", "min").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    keyed = written(keyed.join(many, ["k", "min"]), "minima")
    blocks = keyed.withColumn("salt", F.pmod(F.xxhash64("sig"), F.ceil(F.col("m") / BLOCK)))
    first = written(blocks.join(found, "sig").groupBy("k", "min", "salt").applyInArrow(lambda t: _lead(t.select(["sig", "n", "shingle"]), percent), "a binary, b binary").distinct(), "leads")
    own = written(_labelled(found.select("sig"), first), "components")
    # groups of several components, in pairs of blocks
    keyed = keyed.join(own, "sig")
    apart = keyed.groupBy("k", "min").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("k", "min")
    parts = F.ceil(F.col("m") / (2 * BLOCK)).cast("int")
    pairs_of = keyed.join(apart, ["k", "min"]).withColumn("block", F.pmod(F.xxhash64("sig"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pairs_of = pairs_of.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    second = pairs_of.select("sig", "comp", "k", "min", "lo", "hi", "block").join(found, "sig").groupBy("k", "min", "lo", "hi").applyInArrow(lambda t: _compare(t.select(["sig", "comp", "n", "block", "shingle"]), percent), "a binary, b binary")
    second = written(second.distinct(), "leads")
    own = written(grown(own, "sig", "comp", second), "components")
    placed = found.join(own, "sig").join(minima.select("sig", F.array(*[f"m{k}" for k in range(MINIMA)]).alias("met")), "sig")
    # of n shingles the first n - ceil(n * percent / 100) + 1 by frequency; the unshared ones come before all
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.col("n") - F.size("shingle")
    lists = placed.select("sig", "comp", "met", "n", alone.alias("alone"), F.posexplode(F.slice("shingle", F.lit(1), (prefix - alone).cast("int"))).alias("p", "s"))
    lists = lists.select("sig", "comp", "met", "n", (F.col("p") + F.col("alone")).cast("long").alias("pos"), "s")
    mixed = lists.groupBy("s").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("s")
    pairs = written(lists.join(mixed, "s").groupBy("s").applyInArrow(lambda t: _scan(t.select(["sig", "comp", "met", "n", "pos"]), percent), "a binary, b binary").distinct(), "pairs")
    more = written(_verify(pairs, found, percent), "links")
    return table.select("id", "n", "sig"), first.unionByName(second), own, more


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (id as string, n, sig) for every document, links the verified (a, b) between
    signatures that make up the components. Equal sets share a signature; a set of 0 shingles links with nothing.
    Links inside a component that follow from others aren't all listed.
    """
    members, links, _, more = _joined(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    return members, links.unionByName(more)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id): a row for each document, component_id the least id that links reach from it.

    Ids are numbers. Null and empty texts have 0 shingles and stand alone, each under its own id; a null id takes
    part in links and is never the least unless it stands alone. Repeated rows come out as often as they go in.
    """
    members, _, own, more = _joined(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    kind = docs.schema[id_col].dataType.simpleString()
    m = members.select(F.col("id").cast(kind).alias("id"), "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    comps = grown(own, "sig", "comp", more).select("sig", F.col("comp").alias("component"))
    classes = m.filter("sig is not null").groupBy("sig").agg(F.min("id").alias("own"))
    classes = classes.join(comps, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = classes.groupBy("component").agg(F.min("own").alias("least"))
    classes = classes.join(least, "component").select("sig", "least")
    out = m.join(classes, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents, 5-word shingles, similarity of 0.75 or more."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
