"""Benchmark decontamination with suffix arrays of the training text.

Documents are dealt over shards (runs of rows of some MB). A shard's words are numbered and the suffixes
that begin with a benchmark word are sorted into a suffix array; a suffix that begins with any other word
shares not even one word with a test suffix. Every suffix of every test item is then searched for in every
shard by binary search, word by word, all at once: the interval of the array that agrees in d words is
narrowed to d + 1 until it is empty. That gives each test suffix its longest verbatim match in the shard, and,
at the depth of a window, all places of that window.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window. Words are compared by 64-bit hashes.

The benchmark is the query set: it is read in blocks of at most `block_bytes` of text, and each block
is broadcast by itself. Nulls have no words. Repeated items match alike, each under its own id.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import written
from .textio import ALNUM, BATCH_ROWS, LOWER, Rolling, flat, free, hidden, map_text, runs, words

_U = np.uint64


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and each text's first."""
    data, at = flat(column)
    data = LOWER[data]
    start, end, first = words(data, at, ALNUM)
    return Rolling(data).ranges(start, end), first


class TestSet:
    """The suffixes of a block of benchmark items over a vocabulary of their own."""

    __test__ = False

    def __init__(self, ids: list, texts: list, window: int):
        hashes, first = word_hashes(pa.array(texts, pa.string()))
        self.vocab, code = np.unique(hashes, return_inverse=True)
        self.code = np.append(code.astype(np.int64) + 1, 0)  # 0 ends an item and stands for other words
        n = np.diff(first)
        self.item = np.repeat(np.arange(len(ids)), n)
        self.left = np.repeat(first[1:], n) - np.arange(first[-1])  # words from a suffix's start to its item's end
        self.window = np.minimum(window, np.repeat(n, n))
        self.start = np.arange(first[-1]) - np.repeat(first[:-1], n)
        self.ids = ids

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocab):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0)


def suffix_array(code: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The suffixes that begin with a code over 0, in order; the end of a document (stop: the end of each
    word's document) sorts before all words. Prefix doubling, of the groups that still tie alone."""
    n = len(code)
    sa = np.flatnonzero(code)
    if not len(sa):
        return sa
    rank = np.append(code, 0)
    depth = 1
    tied = sa
    while len(tied):
        nxt = tied + depth
        key2 = np.where(nxt < stop[tied], rank[np.minimum(nxt, n)], 0)
        order = np.lexsort((key2, rank[tied]))
        tied, key2 = tied[order], key2[order]
        own = rank[tied]
        head = np.r_[True, own[1:] != own[:-1]]
        new = np.r_[True, (own[1:] != own[:-1]) | (key2[1:] != key2[:-1])]
        if depth == 1:  # ranks: places in the array, from 1 on; words of no item stay 0
            sa = tied
            rank = np.zeros(n + 1, np.int64)
            base = np.zeros(len(tied), np.int64)
        else:
            group = np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))
            base = own - 1 - group
            sa[own - 1 + np.arange(len(tied)) - group] = tied
        top = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        rank[tied] = base + top + 1
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        # a suffix that has ended, or runs into a word of no item, can't be told from its equals any more
        tied = tied[(np.repeat(size, size) > 1) & (key2 > 0)]
        depth *= 2
    return sa


def search(code: np.ndarray, stop: np.ndarray, sa: np.ndarray, tests: TestSet, floor: np.ndarray | None = None):
    """For each test suffix the length of its longest match, one place of it, and all places of its window.

    Returns (longest, place, suffix, position): the last two pair a test suffix with each word position
    where its window occurs; with `floor`, a length for each, where its longest match does, if that isn't shorter.
    """
    m = len(tests.item)
    longest, place = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    lo, hi, live = np.zeros(m, np.int64), np.full(m, len(sa), np.int64), np.arange(m)
    suffix, position = [], []
    padded = np.append(code, 0)
    deep = np.zeros((2, m), np.int64)

    def places(who, a, b):
        count = b - a
        suffix.append(np.repeat(who, count))
        position.append(sa[np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])

    def bound(a, b, d, want, right):
        """Where `want` goes in the column of d-th words within [a, b)."""
        a, b = a.copy(), b.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            p = sa[np.minimum(mid, len(sa) - 1)] + d
            got = np.where(p < stop[np.minimum(p - d, len(code) - 1)], padded[np.minimum(p, len(code))], 0)
            less = (got <= want if right else got < want) & open_
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        return a

    d = 0
    while len(live) and len(sa):
        live = live[tests.left[live] > d]
        want = tests.code[live + d]
        a = bound(lo[live], hi[live], d, want, False)
        b = bound(a, hi[live], d, want, True)
        lo[live], hi[live] = a, b
        live = live[b > a]
        d += 1
        longest[live], place[live] = d, sa[lo[live]]
        deep[:, live] = lo[live], hi[live]
        if floor is None:
            full = live[(tests.window[live] == d) & (tests.left[live] >= d)]
            places(full, lo[full], hi[full])
    if floor is not None:
        best = np.flatnonzero((longest > 0) & (longest >= floor))
        places(best, *deep[:, best])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return longest, place, cat(suffix), cat(position)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items in blocks; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if row.t:
            ids.append(row.i)
            texts.append(row.t)
            size += len(row.t.encode())
            if size >= block_bytes:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_SPAN = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))


def _spans(tests: list):
    """For map_text: each document's number of words and its verbatim matches with blocks of the benchmark (broadcast
    TestSets): the matches of the depth of a window or more, in runs along one diagonal of (item, document)."""

    def make():
        def of(part):
            hashes, first = word_hashes(part.column("body"))
            spans: list[list] = [[] for _ in range(len(first) - 1)]
            stop = np.repeat(first[1:], np.diff(first))
            for block in tests:
                t = block.value
                code = t.codes(hashes)
                _, _, suffix, position = search(code, stop, suffix_array(code, stop), t)
                if not len(suffix):
                    continue
                width = t.window[suffix]
                doc = np.searchsorted(first, position, "right") - 1
                item, diagonal = t.item[suffix], position - t.start[suffix]
                order = np.lexsort((position, diagonal, item, doc))
                key = np.stack([doc, item, diagonal])[:, order]
                p = position[order]
                heads = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0) | (p[1:] != p[:-1] + 1)])
                for h, e in zip(heads, np.append(heads[1:], len(p)) - 1):
                    d = int(key[0, h])
                    spans[d].append({"item": str(t.ids[key[1, h]]), "item_start": int(t.start[suffix[order[h]]]), "doc_start": int(p[h] - first[d]), "n_words": int(p[e] - p[h] + width[order[e]])})
            return [pa.array(np.diff(first), pa.int64()), pa.array(spans, _SPAN)]

        return of

    return make


def _covered(spans: str) -> F.Column:
    """The number of words inside any of a document's spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    begin = lambda s: F.greatest(s["doc_start"], F.lit(0).cast("long"))
    stop = lambda s: s["doc_start"] + s["n_words"]
    step = lambda acc, s: F.struct(F.greatest(acc["end"], stop(s)).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), stop(s) - F.greatest(acc["end"], begin(s)))).alias("n"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["doc_start"].alias("doc_start"), s["n_words"].alias("n_words"))))
    return F.aggregate(ordered, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 4 << 20, held: int = 8, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: the columns `keep` (its id by default), and

    n_words; n_hit, words inside an occurrence of a window; items, the ids (as strings, sorted) of the items with
    occurring windows; spans, the longest verbatim matches as (item, item_start, doc_start, n_words), in words.
    Null and empty documents have none of these; repeated documents count each; without items nothing is hit.
    Of `keep`, a column with one of these names stays, and the made one gets an underscore before its name.

    Up to `held` blocks are searched in one pass, without a shuffle. Beyond that the documents are numbered in a written
    table, so many blocks are broadcast, searched in a pass of their own and let go, and only what matches is put together.
    """
    sc = docs.sparkSession.sparkContext
    plain, name = hidden(docs)
    kept = [name[c] for c in keep or [id_col]]
    made = "n_words long, spans array<struct<item: string, item_start: long, doc_start: long, n_words: long>>"
    blocks = (TestSet(*block, window) for block in _blocks(benchmark, item_col, item_text, block_bytes))
    batch = [sc.broadcast(t) for t in itertools.islice(blocks, held)]
    following = next(blocks, None)
    if following is None:
        found = map_text(plain, name[text_col], kept, made, _spans(batch))
    else:
        blocks = itertools.chain([following], blocks)
        own = written(plain.select(*kept, F.col(name[text_col]).cast("string").alias("body"), F.monotonically_increasing_id().alias("row")), "numbered")
        parts = []
        while batch:
            parts.append(written(map_text(own, "body", ["row"], made, _spans(batch)).filter("size(spans) > 0").select("row", "spans"), "spans"))
            for block in batch:
                block.destroy()
            batch = [sc.broadcast(t) for t in itertools.islice(blocks, held)]
        spans = functools.reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        counted = map_text(own, "body", [*kept, "row"], made, _spans([])).drop("spans")
        found = counted.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    out = found.select(*kept, "n_words", _covered("spans").alias("n_hit"), F.array_sort(F.array_distinct("spans.item")).alias("items"), "spans")
    wanted = keep or [id_col]
    return out.toDF(*wanted, *[free(n, wanted) for n in ("n_words", "n_hit", "items", "spans")])


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(item, item_start, n_words, id, doc_start): for each test suffix, the longest verbatim match that any document has
    from its start on, and one place of it (of equals the least id, then the least place).

    Suffixes without a match have no row, nor have items and documents without words; a null id is the last of
    equals. Each task sends one row for a suffix at most, the longest of all its shards; `item` is a string.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    inner = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    parts = []
    for ids, texts in _blocks(benchmark, item_col, item_text, block_bytes):
        block = spark.sparkContext.broadcast(TestSet(ids, texts, 1))

        def best(batches, block=block):
            t = block.value
            length, at = np.zeros(len(t.item), np.int64), np.zeros(len(t.item), np.int64)
            who: list = [None] * len(t.item)
            for batch in batches:
                for part in runs(batch, "body"):
                    hashes, first = word_hashes(part.column("body"))
                    code, stop = t.codes(hashes), np.repeat(first[1:], np.diff(first))
                    names = part.column("id").to_pylist()
                    rank = np.empty(len(names), np.int64)
                    rank[sorted(range(len(names)), key=lambda d: (names[d] is None, names[d]))] = np.arange(len(names))
                    longest, _, suffix, position = search(code, stop, suffix_array(code, stop), t, length)
                    doc = np.searchsorted(first, position, "right") - 1
                    order = np.lexsort((position, rank[doc], suffix))
                    for k in order[np.flatnonzero(np.diff(suffix[order], prepend=-1))].tolist():
                        s, d = int(suffix[k]), int(doc[k])
                        n, mine = int(longest[s]), (names[d] is None, names[d], int(position[k] - first[d]))
                        if n > length[s] or mine < (who[s] is None, who[s], int(at[s])):
                            length[s], who[s], at[s] = n, names[d], mine[2]
            i = np.flatnonzero(length)
            yield pa.RecordBatch.from_arrays([pa.array([str(t.ids[k]) for k in t.item[i]], pa.string()), pa.array(t.item[i], pa.int64()), pa.array(t.start[i], pa.int64()), pa.array(length[i], pa.int64()), pa.array([who[k] for k in i.tolist()], kinds), pa.array(at[i], pa.int64())], names=["item", "n", "item_start", "n_words", "id", "doc_start"])

        kinds = to_arrow_type(docs.schema[id_col].dataType)
        parts.append(inner.mapInArrow(best, f"item string, n long, item_start long, n_words long, id {kind}, doc_start long").withColumn("block", F.lit(len(parts))))
    if not parts:
        return spark.createDataFrame([], f"item string, item_start long, n_words long, id {kind}, doc_start long").withColumnRenamed("id", id_col)
    first = F.min(F.struct((-F.col("n_words")).alias("m"), F.col("id").isNull().alias("last"), "id", "doc_start")).alias("x")
    out = functools.reduce(DataFrame.unionByName, parts).groupBy("block", "n", "item", "item_start").agg(first)
    return out.select("item", "item_start", (-F.col("x.m")).alias("n_words"), F.col("x.id").alias(id_col), F.col("x.doc_start").alias("doc_start"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without a hit word, with all columns, whatever their names; a null or empty text stays, repeated
    rows stay or go together."""
    plain, name = hidden(docs)
    found = contamination(plain, benchmark, id_col=name[id_col], text_col=name[text_col], keep=plain.columns, **options)
    return found.filter("n_hit = 0").select(*plain.columns).toDF(*docs.columns)


def digest(ids: list) -> str:
    """The items_sha256 of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def op3_suffix_search(spark, sf_dir: str) -> DataFrame:
    """All whole documents against all benchmark items, windows of 10 words."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
