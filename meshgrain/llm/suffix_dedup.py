"""Suffix-array dedup: bytes inside a string of `width` bytes that also starts elsewhere are removed.

1. Anchors. Each window of `width` bytes has an anchor, the 64-byte string in it with the least hash (the leftmost of
   equals): equal windows have equal anchors at equal places. Consecutive windows with one anchor form a segment. Anchors
   are counted over the corpus; a window whose anchor occurs once occurs once. A bitmap of fixed size marks the
   hashes of repeated anchors; what it marks wrongly is sorted out below.
2. Suffix arrays. Segments with marked anchors meet by anchor. From their anchor on, to both sides, they are cut into
   64-byte blocks, the symbols of a text over which a suffix array is built by linear grouping:
   groups of suffixes by their Lyndon prefix, processed in descending order, with pointers to the
   previous smaller suffix; then each group's order is emitted in one sweep. Nothing is renamed recursively.
3. Windows. A window holds five whole blocks at least. Suffixes next to each other in the array that agree in five
   symbols make an interval; windows in an interval are equal if their ends, before and after the five blocks, are.
4. Ranges of repeated windows go back to their texts by the text's digest, and what is left is hashed.

Texts that occur more than once are one text in steps 1 to 3. Strings never cross documents.

Apart from it, and no part of the removal, sharing() finds the documents that share a passage of words with another, whatever its bytes:
of the 26-word strings in each 51 words the one of least hash is an anchor; anchors that several texts have are marked
in a bitmap as above, and where they meet, the 51-word strings around them are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textio import BATCH_ROWS, NOT_SPACE, Rolling, flat, mix, powers, runs, words

_U = np.uint64
GRAM = 64
#: Window starts that are worked on at once; a longer text is worked on in stretches of it.
STRETCH = 1 << 19
_PLACE = (1 << 20) - 1
#: Bits of the bitmap of repeated anchors.
MAP_BITS = 26
#: Text bytes for each bin of anchors.
BIN_BYTES = 4 << 20
#: Occurrences of a word anchor beyond which each string around it is dealt by itself.
OFTEN = 1000


def lyndon_groups(t: list[int]) -> tuple[list[int], list[int]]:
    """First phase: each suffix's group (a number that orders groups by Lyndon prefix) and its previous smaller suffix.

    The last symbol of t is its least and occurs once. Groups start with the first symbols and are finished from the
    highest on: the suffixes before a finished group's members, by their pointers, are extended by its prefix, once or
    several times in a row, and so move up behind the rest of their group.
    """
    n = len(t)
    sa = np.argsort(t, kind="stable")
    sorted_ = np.asarray(t)[sa]
    start = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    size = np.diff(np.append(start, n))
    of = np.empty(n, np.int64)
    of[sa] = np.repeat(start, size)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    end_ = np.zeros(n, np.int64)
    end_[start] = start + size
    sa, group, place, end = sa.tolist(), of.tolist(), place.tolist(), end_.tolist()
    prev = [-1] * n

    def move(g: int, who: list[int]) -> None:
        last = e = end[g]
        if len(who) == last - g:
            return
        for j in who:
            e -= 1
            x, p = sa[e], place[j]
            sa[p], place[x] = x, p
            sa[e], place[j] = j, e
            group[j] = e
        for j in who:
            group[j] = e
        end[g], end[e] = e, last

    high = n
    while high:
        low = group[sa[high - 1]]
        if high - low == 1:
            i = sa[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                move(group[j], [j])
        else:
            runs: list[list[int]] = []
            last = -2
            for i in sorted(sa[low:high]):
                j = i - 1
                while j >= 0 and group[j] >= low:
                    j = prev[j]
                prev[i] = j
                if j == last:
                    runs[-1][0] += 1
                else:
                    runs.append([1, j])
                    last = j
            times: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
            for k, j in runs:
                if j >= 0:
                    times[k][group[j]].append(j)
            if len(times) == 1:
                for g, who in next(iter(times.values())).items():
                    move(g, who)
            else:
                for k in sorted(times, reverse=True):
                    again: dict[int, list[int]] = defaultdict(list)
                    for who in times[k].values():
                        for j in who:
                            again[group[j]].append(j)
                    for g, who in again.items():
                        move(g, who)
        high = low
    return group, prev


def suffix_array(t: list[int]) -> list[int]:
    """Second phase: suffixes are taken in order; each puts the suffixes that begin before it, up the chain of
    pointers, at the front of what is free of their groups."""
    n = len(t)
    group, prev = lyndon_groups(t)
    free = list(range(n))
    done = bytearray(n)
    sa = [-1] * n
    sa[0] = n - 1
    done[n - 1] = 1
    for r in range(n):
        j = sa[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            p = free[g]
            sa[p] = j
            free[g] = p + 1
            done[j] = 1
            j = prev[j]
    return sa


def _stretches(data: np.ndarray, at: np.ndarray, width: int):
    """Parts of a batch: (bytes, where its texts begin and end, each one's text, each one's offset in its text)."""
    take, size = [], 0

    def part():
        ends = np.cumsum([b - a for _, a, b in take])
        return np.concatenate([data[at[d] + a : at[d] + b] for d, a, b in take]), np.r_[0, ends], [d for d, _, _ in take], [a for _, a, _ in take]

    for d, n in enumerate(np.diff(at).tolist()):
        for a in range(0, max(0, n - width + 1), STRETCH):
            b = min(n, a + STRETCH + width - 1)
            if take and size + b - a > STRETCH:
                yield part()
                take, size = [], 0
            take.append((d, a, b))
            size += b - a
    if take:
        yield part()


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each `span` consecutive hashes, by their upper 44 bits, the first of equals."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (hashes & ~_U(_PLACE)) | np.arange(len(hashes), dtype=_U)
    rows = -(-len(key) // span)
    padded = np.full(rows * span, ~_U(0))
    padded[: len(key)] = key
    table = padded.reshape(rows, span)
    right = np.minimum.accumulate(table, axis=1).ravel()
    left = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(left[:n], right[span - 1 : span - 1 + n]) & _U(_PLACE)).astype(np.int64)


def segments(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(first window, end of windows, anchor, anchor's hash) of each segment, in order."""
    roll = Rolling(data)
    grams = roll.grams(GRAM)
    least = _least(grams, width - GRAM + 1)
    n = len(data) - width + 1
    stop = np.repeat(at[1:], np.diff(at))[:n]
    i = np.flatnonzero(np.arange(n) + width <= stop)
    anchor = least[i]
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (i[1:] != i[:-1] + 1)]) if len(i) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(i)) - 1 if len(i) else head
    return i[head], i[tail] + 1, anchor[head], grams[anchor[head]]


def _count(batches, width: int):
    """Each anchor's hash and the number of its occurrences, by stretch."""
    for batch in batches:
        data, at = flat(batch.column("body"))
        for part, cut, _, _ in _stretches(data, at, width):
            f, c = np.unique(segments(part, cut, width)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(c.astype(np.int64))], names=["f", "c"])


_SEGMENT = "bin long, bytes binary, anchor int, digests array<binary>, starts array<long>"


def _emit(batches, width: int, marked, bins: int):
    """The segments with marked anchors; equal ones of a task are one, with their texts and places."""
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    held: dict[tuple[bytes, int], tuple[int, dict]] = {}
    size = 0

    def flush():
        rows = [(b, raw, a, [d for d, _ in who], [s for _, s in who]) for (raw, a), (b, who) in held.items()]
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 2000]), kinds)], names=names)

    for batch in batches:
        data, at = flat(batch.column("body"))
        digest = batch.column("digest").to_pylist()
        for part, cut, texts, offset in _stretches(data, at, width):
            first, end, anchor, f = segments(part, cut, width)
            keep = _is_marked(marked, f)
            first, end, anchor, f = first[keep], end[keep], anchor[keep], f[keep]
            own = np.searchsorted(cut, first, "right") - 1
            raw = part.tobytes()
            for s, e, a, b, o in zip(first.tolist(), end.tolist(), anchor.tolist(), ((f >> _U(20)) % _U(bins)).tolist(), own.tolist()):
                bytes_ = raw[s : e + width - 1]
                got = held.get((bytes_, a - s))
                if got is None:
                    got = held[bytes_, a - s] = (b, {})
                    size += len(bytes_)
                got[1][digest[texts[o]], s - int(cut[o]) + offset[o]] = None
                size += 40
            if size > 24 << 20:
                yield from flush()
                held.clear()
                size = 0
    yield from flush()


def _repeated(table: pa.Table, width: int) -> pa.Table:
    """The byte ranges (digest, from, to) of the repeated windows of a bin's segments."""
    whole = (width - (GRAM - 1)) // GRAM  # blocks in every window
    found: dict[tuple[bytes, int], set] = {}
    for raw, a, digests, starts in zip(*(table.column(c).to_pylist() for c in ("bytes", "anchor", "digests", "starts"))):
        found.setdefault((raw, a), set()).update(zip(digests, starts))
    raws = [r for r, _ in found]
    members = list(found.values())
    size = np.array([len(r) for r in raws])
    base = np.r_[0, np.cumsum(size)]
    roll = Rolling(np.frombuffer(b"".join(raws), np.uint8))
    lead = np.array([a % GRAM for _, a in found])  # bytes before the first block
    blocks = (size - lead) // GRAM
    seg = np.repeat(np.arange(len(raws)), blocks)
    index = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = base[seg] + lead[seg] + GRAM * index
    _, symbol = np.unique(roll.ranges(begin, begin + GRAM), return_inverse=True)
    # the text: every segment's symbols (from 2 on) and a 1; a 0 ends it
    where = np.arange(len(seg)) + seg
    text = np.ones(len(seg) + len(raws) + 1, np.int64)
    text[where] = symbol + 2
    text[-1] = 0
    sa = np.array(suffix_array(text.tolist()))
    padded = np.r_[text, np.zeros(whole, np.int64)]
    same = np.ones(len(sa) - 1, bool)
    inside = np.ones(len(sa), bool)
    for k in range(whole):
        col = padded[sa + k]
        same &= col[1:] == col[:-1]
        inside &= col > 1
    same &= inside[1:] & inside[:-1]
    interval = np.r_[0, np.cumsum(~same)]
    members_of = np.bincount(interval)
    interval_at = np.full(len(text), -1)
    interval_at[sa] = np.where(inside & (members_of[interval] > 1), interval, -1)
    # windows: offset o in a segment; its first whole block
    windows = size - width + 1
    ws = np.repeat(np.arange(len(raws)), windows)
    o = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    many = np.array([len(m) > 1 for m in members])
    b = np.maximum(0, -(-(o - lead[ws]) // GRAM))
    text_base = np.r_[0, np.cumsum(blocks + 1)][:-1]
    inter = interval_at[text_base[ws] + b]
    test = np.flatnonzero(inter >= 0)
    start = base[ws[test]] + o[test]
    inner = base[ws[test]] + lead[ws[test]] + GRAM * b[test]
    key = np.empty((len(test), 3), np.uint64)
    key[:, 0] = (inter[test].astype(_U) << _U(8)) | (inner - start).astype(_U)
    key[:, 1] = roll.ranges(start, inner)
    key[:, 2] = roll.ranges(inner + whole * GRAM, start + width)
    order = np.lexsort(key.T)
    k = key[order]
    new = np.r_[True, (k[1:] != k[:-1]).any(1)] if len(k) else np.zeros(0, bool)
    count = np.diff(np.append(np.flatnonzero(new), len(k)))
    again = many[ws]
    again[test[order]] |= np.repeat(count > 1, count)
    # runs of repeated windows
    hit = np.flatnonzero(again)
    edge = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (ws[hit[1:]] != ws[hit[:-1]])]) if len(hit) else np.zeros(0, np.int64)
    out = []
    for h, e in zip(hit[edge].tolist(), hit[np.append(edge[1:], len(hit)) - 1].tolist() if len(hit) else []):
        a, z = int(o[h]), int(o[e]) + width
        out += [(d, s + a, s + z) for d, s in members[ws[h]]]
    return pa.table({"digest": pa.array([x[0] for x in out], pa.binary()), "a": pa.array([x[1] for x in out], pa.int64()), "z": pa.array([x[2] for x in out], pa.int64())})


def _marked(anchors: DataFrame):
    """A broadcast bitmap of MAP_BITS bits, with those of the hashes f set."""
    slot = F.col("f").bitwiseAND(F.lit((1 << MAP_BITS) - 1))

    def pack(key, table):
        bits = np.zeros(1 << 16, np.uint8)
        bits[table.column("low").to_numpy()] = 1
        return pa.table({"page": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    pages = anchors.select(F.shiftright(slot, 16).alias("page"), slot.bitwiseAND(F.lit(0xFFFF)).alias("low")).distinct().groupBy("page").applyInArrow(pack, "page long, bits binary")
    bitmap = bytearray(1 << (MAP_BITS - 3))
    for r in pages.toLocalIterator():
        bitmap[r.page << 13 : (r.page + 1) << 13] = r.bits
    return anchors.sparkSession.sparkContext.broadcast(bytes(bitmap))


def _is_marked(marked, f: np.ndarray) -> np.ndarray:
    slot = f & _U((1 << MAP_BITS) - 1)
    return (np.frombuffer(marked.value, np.uint8)[(slot >> _U(3)).astype(np.int64)] >> (slot & _U(7)).astype(np.uint8)) & 1 > 0


def repeats(docs: DataFrame, *, text_col: str = "text", width: int = 400) -> DataFrame:
    """(digest, a, z): byte ranges of distinct texts (by MD5) that are covered by strings which recur, in a different
    text or in the same. Texts that occur several times aren't compared with themselves."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(text.alias("body"), F.unhex(F.md5(text)).alias("digest")).filter(F.octet_length("body") >= width)
    anchors = rows.select("body").mapInArrow(lambda it: _count(it, width), "f long, c long").groupBy("f").agg(F.sum("c").alias("c")).filter("c > 1")
    marked = _marked(anchors)
    volume = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bins = max(12, math.ceil(volume / BIN_BYTES))
    found = rows.mapInArrow(lambda it: _emit(it, width, marked, bins), _SEGMENT)
    return found.groupBy("bin").applyInArrow(lambda t: _repeated(t, width), "digest binary, a long, z long")


def _word_anchors(column: pa.Array, size: int):
    """The anchors of all strings of `size` words: hash, text, and for each of the strings that can hold it, from the one that
    ends with it on, 32 bits of the string's hash, or 0 where it would leave the text."""
    data, at = flat(column)
    start, end, first = words(data, at, NOT_SPACE)
    h = Rolling(data).ranges(start, end)
    gram = (size + 1) // 2
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * up[:-1], out=total[1:])
    strings = lambda i, k: mix((total[i + k] - total[i]) * down[i])
    stop = np.repeat(first[1:], np.diff(first))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), lambda which: np.zeros((0, gram), np.uint32)
    grams = strings(np.arange(len(h) - gram + 1), gram)
    found = []
    for a in range(0, n, STRETCH):  # places fit their bits
        i = np.flatnonzero(np.arange(a, min(a + STRETCH, n)) + size <= stop[a : min(a + STRETCH, n)])
        found.append(np.unique(_least(grams[a : a + STRETCH + size - gram], size - gram + 1)[i]) + a)
    anchor = np.unique(np.concatenate(found))
    text = np.searchsorted(first, anchor, "right") - 1

    def around(which: np.ndarray) -> np.ndarray:
        p = anchor[which]
        out = np.zeros((len(p), size - gram + 1), np.uint32)
        for k in range(size - gram + 1):
            i = p - (size - gram) + k
            ok = (i >= first[text[which]]) & (i + size <= stop[p])
            out[ok, k] = np.maximum(strings(i[ok], size) >> _U(32), 1).astype(np.uint32)
        return out

    return grams[anchor], text, around


_PLACE_ROW = "bin long, f long, digest binary, around binary"


def _meet(table: pa.Table, strings: int) -> pa.Table:
    """(digest): the texts of a bin with an anchor around which another text has the same string. Texts without strings (null)
    are such already; where they're empty, f stands for a single string."""
    around = table.column("around").to_pylist()
    digest = np.array(table.column("digest").to_pylist(), object)
    known = np.array([a is None for a in around], bool)
    single = np.array([a == b"" for a in around], bool)
    f = table.column("f").to_numpy().view(_U)
    text, code = np.unique(digest[~known], return_inverse=True)
    shared = np.zeros(len(text), bool)
    code_of = np.zeros(len(f), np.int64)
    code_of[~known] = code

    def compare(key, who):
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        last = np.append(head[1:], len(key)) - 1 if len(key) else head
        shared[who[np.repeat(who[head] != who[last], last - head + 1)]] = True

    compare(f[single], code_of[single])
    rest = ~known & ~single
    f, code = f[rest], code_of[rest]
    around = np.frombuffer(b"".join(a for a in around if a), np.uint32).reshape(-1, strings)
    for k in range(strings):
        i = np.flatnonzero(around[:, k])
        compare(mix(f[i] ^ (around[i, k].astype(_U) << _U(8))), code[i])
    return pa.table({"digest": pa.array([*text[shared], *set(digest[known])], pa.binary())})


def shared_passages(docs: DataFrame, *, text_col: str = "text", size: int = 51) -> DataFrame:
    """(digest): the distinct texts (by MD5) that have a string of `size` words, [^\\x20\\x09-\\x0D]+ with any blanks between,
    which another text has as well. A string that recurs in one text alone, and texts that occur several times, aren't found
    here. Null counts as empty.

    A task sends an anchor with the same surroundings once, with its first text; the others that have it are known to share a
    string, and so is the first, so that a passage in very many texts doesn't come once for each of them. Of an anchor that
    many texts have, each string around it goes to a bin by itself.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(text.alias("body"), F.unhex(F.md5(text)).alias("digest")).filter(F.octet_length("body") >= 2 * size - 1)

    def count(batches):
        for batch in batches:
            for part in runs(batch, "body"):
                f, own, _ = _word_anchors(part.column("body"), size)
                _, digests = np.unique(np.array(part.column("digest").to_pylist(), object), return_inverse=True)
                pairs = np.unique(np.stack([f.view(np.int64), digests[own]]), axis=1)[0] if len(f) else f.view(np.int64)
                f, c = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(c.astype(np.int64))], names=["f", "c"])

    anchors = written(rows.select("body", "digest").mapInArrow(count, "f long, c long").groupBy("f").agg(F.sum("c").alias("c")).filter("c > 1"), "word-anchors")
    marked, often = _marked(anchors), _marked(anchors.filter(F.col("c") > OFTEN))
    volume = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bins = max(12, math.ceil(volume / BIN_BYTES))

    def strings_of(g: int, around: np.ndarray) -> list[tuple[int, bytes]]:
        k = np.flatnonzero(around).astype(_U)
        return [(x, b"") for x in mix(_U(g) ^ mix(around[k].astype(_U) << _U(8) | k)).tolist()]

    def emit(batches):
        seen: set[bytes] = set()
        held: dict[tuple[int, bytes], bytes] = {}
        told: set[bytes] = set()
        for batch in batches:
            for part in runs(batch, "body"):
                f, own, around = _word_anchors(part.column("body"), size)
                digest = part.column("digest").to_pylist()
                fresh = np.array([d not in seen and not seen.add(d) for d in digest], bool)  # a text once in a task
                keep = np.flatnonzero(_is_marked(marked, f) & fresh[own]) if len(f) else np.zeros(0, np.int64)
                rows = []
                found = zip(f[keep].tolist(), own[keep].tolist(), np.ascontiguousarray(around(keep)), _is_marked(often, f[keep]).tolist())
                for g, o, w in ((g, o, w) for g, o, w, hot in found for g, w in (strings_of(g, w) if hot else ((g, w.tobytes()),))):
                    d = digest[o]
                    first = held.setdefault((g, w), d)
                    if first is d:
                        rows.append(((g >> 20) % bins, g - (g >> 63 << 64), d, w))
                    elif first != d:
                        for x in (first, d):
                            if x not in told:
                                told.add(x)
                                rows.append((x[0] % bins, 0, x, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bin", "f", "digest", "around"])
                if len(seen) + len(held) > 1 << 20:
                    seen.clear(), held.clear(), told.clear()

    strings = size - (size + 1) // 2 + 1
    return rows.mapInArrow(emit, _PLACE_ROW).groupBy("bin").applyInArrow(lambda t: _meet(t, strings), "digest binary").distinct()


def sharing(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 51) -> DataFrame:
    """(id, shares): for each document whether another has a string of `size` words of it; copies of a text that is long enough share
    theirs. Null counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    long = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")) >= size
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), long.alias("long"), F.unhex(F.md5(text)).alias("digest"))
    copies = rows.filter("long").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    found = copies.unionByName(shared_passages(docs, text_col=text_col, size=size)).distinct().withColumn("shares", F.lit(True))
    return rows.join(found, "digest", "left").select(F.col("id").alias(id_col), F.coalesce("shares", F.lit(False)).alias("shares"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): a row for each document; spans are the maximal removed runs
    (from, to), in bytes, kept is what remains, as bytes.

    A null text counts as empty; texts under `width` bytes keep all. Equal texts have equal results; a text of `width`
    bytes or more that occurs twice goes altogether, its first occurrence too. A cut may fall inside a character.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("body"), F.unhex(F.md5(text)).alias("digest"))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", F.lit(True).alias("copied"))
    ranges = repeats(docs, text_col=text_col, width=width).groupBy("digest").agg(F.collect_list(F.struct("a", "z")).alias("ranges"))
    joined = rows.join(ranges.join(copies, "digest", "full"), "digest", "left").select("id", "body", "copied", F.col("ranges.a").alias("a"), F.col("ranges.z").alias("z"))

    def cut(batches):
        for batch in batches:
            data, at = flat(batch.column("body"))
            spans, kept = [], []
            for i, (copied, a, z) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("copied", "a", "z")))):
                own = data[at[i] : at[i + 1]]
                n = len(own)
                if copied and n >= width:
                    a, z = [0], [n]
                depth = np.zeros(n + 1, np.int32)
                np.add.at(depth, a or [], 1)
                np.add.at(depth, z or [], -1)
                stay = np.cumsum(depth[:-1]) == 0
                edge = np.flatnonzero(np.diff(np.r_[True, stay, True].astype(np.int8)))
                spans.append([{"a": int(x), "z": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                kept.append(own[stay].tobytes())
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(cut, f"id {kind}, n_bytes long, spans array<struct<a: long, z: long>>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), "spans", "kept")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All whole texts, strings of 400 bytes."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
