"""The terms of A^T A as bytes. A row's entries go to each of its columns; what is sent to one place in one go is one blob, which has
places as differences in bytes of 7 bits, and values by number where there are few. Numpy arrays; nulls are the lowest column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Terms that are spread or added up at once, about; values that are sent by number.
TERMS, FEW = 1 << 21, 16
#: A value that is null: a NaN that no computation gives.
NULL = np.uint64(0x7FF80000_5EED0001)
SIGN = np.uint64(1 << 63)
BLOBS, ENTRIES = "dest int, blob binary, own double", "i {0}, j {0}, v double"


def to_bytes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers (uint64) in bytes of 7 bits, the lowest first, and where each ends."""
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        more = x >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(x) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        have = np.flatnonzero(size > k)
        out[end[have] - size[have] + k] = ((x[have] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[have] > k + 1).astype(np.uint8) << 7)
    return out, end


def from_bytes(b: np.ndarray) -> np.ndarray:
    if not len(b):
        return np.zeros(0, np.uint64)
    end = np.flatnonzero(b < 128)
    start = np.r_[0, end[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _flat(c: pa.ListArray, bits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Items as 64 bits and which are null, those of values as NULL."""
    flat = c.flatten()
    null = flat.is_null().to_numpy(zero_copy_only=False)
    if bits:
        out = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).copy().view(np.uint64)
        out[null] = NULL
        return out, null
    return flat.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ SIGN, null


def _numbered(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of few values and each one's number, or no table and the values."""
    table, at = np.unique(bits, return_inverse=True)
    return (table, at.astype(np.uint8)) if len(table) <= FEW else (np.zeros(0, np.uint64), bits)


def spread(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.RecordBatch]:
    """Rows of two lists of entries (js, ws) and (ks, vs), as BLOBS: each entry of the first with those of the second that have no lower
    column, for the place that the first's column hashes to. Null columns have a place of their own, and their terms with each other in `own`."""
    for batch in batches:
        sizes = lambda c: np.diff(batch[c].offsets.to_numpy()).astype(np.int64)  # noqa: E731, B023
        work = np.cumsum(sizes("js") * sizes("ks")) // TERMS
        cuts = np.flatnonzero(np.r_[True, work[1:] != work[:-1], True]) if len(work) else [0]
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield from _spread(batch.slice(int(s), int(e - s)), places)


def _spread(t: pa.RecordBatch, places: int) -> Iterator[pa.RecordBatch]:
    sizes = lambda c: np.diff(t[c].offsets.to_numpy()).astype(np.int64)
    (j, no_j), (w, _), (k, no_k), (v, _) = _flat(t["js"]), _flat(t["ws"], True), _flat(t["ks"]), _flat(t["vs"], True)
    left, right = np.repeat(np.arange(t.num_rows), sizes("js")), np.repeat(np.arange(t.num_rows), sizes("ks"))
    own = []  # of rows with null columns in both lists
    for r in np.intersect1d(left[no_j], right[no_k]):
        a, b = w[no_j & (left == r)], v[no_k & (right == r)]
        a, b = a[a != NULL].view(float), b[b != NULL].view(float)
        own.append(float(np.outer(a, b).sum()) if len(a) and len(b) else None)
    order = np.lexsort((k, right))
    order = order[~no_k[order]]
    k, v, right = k[order], v[order], right[order]
    end = np.searchsorted(right, np.arange(t.num_rows), "right")[left]
    # entries of both lists in one order, the first list's before equal ones of the second
    both = np.lexsort((np.r_[np.zeros(len(j), bool), np.ones(len(k), bool)], np.r_[j, k], np.r_[left, right]))
    before = np.cumsum(both >= len(j))
    start = np.empty(len(j), np.int64)
    mine = both < len(j)
    start[both[mine]] = before[mine]
    start[no_j] = np.searchsorted(right, left[no_j], "left")
    with np.errstate(over="ignore"):
        dest = ((j * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % places
    dest[no_j] = places
    base = np.where(no_j, np.uint64(0), j)
    order = np.lexsort((base, dest))
    order = order[end[order] > start[order]]
    dest, base, w, start = dest[order], base[order], w[order], start[order]
    count = end[order] - start
    at = _ranges(start, count)
    heads = np.cumsum(count) - count
    step = np.empty(len(at), np.uint64)
    step[1:] = k[at[1:]] - k[at[:-1]]
    step[heads] = k[start] - base
    steps, step_end = to_bytes(step)
    table, number = _numbered(v)
    cuts = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1], True]) if len(dest) else np.zeros(1, np.int64)
    places_, blobs = [], []
    for s, e in zip(cuts[:-1], cuts[1:]):
        f, g = int(heads[s]), int(heads[e - 1] + count[e - 1])
        bases = to_bytes(np.r_[base[s], np.diff(base[s:e])])[0]
        counts = to_bytes(count[s:e].astype(np.uint64))[0]
        own_table, own_number = _numbered(w[s:e])
        inner = steps[step_end[f - 1] if f else 0 : step_end[g - 1]]
        values = number[at[f:g]] if len(table) != 1 else number[:0]
        head = np.array([len(bases), len(counts), len(inner), len(own_table), len(table), e - s, g - f], np.int64)
        blobs.append(b"".join(p.tobytes() for p in (head, bases, counts, inner, own_table, table, own_number, values)))
        places_.append(int(dest[s]))
    if places_:
        yield pa.RecordBatch.from_arrays([pa.array(places_, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.float64())], ["dest", "blob", "own"])
    if own:
        yield pa.RecordBatch.from_arrays([pa.array([places] * len(own), pa.int32()), pa.array([b""] * len(own), pa.binary()), pa.array(own, pa.float64())], ["dest", "blob", "own"])


def terms(blob: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(to, column, product, whether it is null) of a blob's terms."""
    head = np.frombuffer(blob, np.int64, 7)
    at = 56

    def take(n: int, kind: type) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    base, count, step = (from_bytes(take(int(n), np.uint8)) for n in head[:3])
    own_table, table = take(int(head[3]), np.uint64), take(int(head[4]), np.uint64)
    w = own_table[take(int(head[5]), np.uint8)] if len(own_table) else take(int(head[5]), np.uint64)
    v = table[take(int(head[6]), np.uint8)] if len(table) > 1 else np.repeat(table, int(head[6])) if len(table) else take(int(head[6]), np.uint64)
    base, count = np.cumsum(base), count.astype(np.int64)
    heads = np.cumsum(count) - count
    total = np.cumsum(step)  # wraps around, as do the differences
    column = total - np.repeat(total[heads] - step[heads], count) + np.repeat(base, count)
    w = np.repeat(w, count)
    return np.repeat(base, count), column, w.view(float) * v.view(float), (w == NULL) | (v == NULL)


def _added(to: np.ndarray, column: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums v and n of equal (to, column)."""
    rows, r = np.unique(to, return_inverse=True)
    columns, c = np.unique(column, return_inverse=True)
    key = r * len(columns) + c
    if len(rows) * len(columns) <= 4 * len(key):
        have = np.flatnonzero(np.bincount(key))
        add = lambda x: np.bincount(key, x)[have]
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        have = key[first]
        add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
    return rows[have // max(1, len(columns))], columns[have % max(1, len(columns))], add(v), add(n)


def add_up(batches: Iterator[pa.RecordBatch], places: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """ENTRIES of one place's blobs, both halves."""
    parts: list[tuple[np.ndarray, ...]] = []
    held, limit, own, is_null_place = 0, TERMS, [], False

    def merge() -> None:
        nonlocal parts, held, limit
        if len(parts) > 1 or held:
            parts = [_added(*(np.concatenate(x) for x in zip(*parts)))]
        held, limit = 0, max(TERMS, len(parts[0][0]) if parts else 0)

    for batch in batches:
        is_null_place = batch["dest"][0].as_py() == places
        for blob, one in zip(batch["blob"], batch["own"]):
            if not len(blob.as_buffer()):
                own.append(one.as_py())
                continue
            to, column, v, null = terms(memoryview(blob.as_buffer()))
            parts.append((to, column, np.where(null, 0.0, v), 1.0 - null))
            held += len(to)
            if held > limit:
                merge()
    merge()
    for to, column, v, n in parts:
        i, j = (pa.array((x ^ SIGN).view(np.int64)).cast(kind) for x in (to, column))
        if is_null_place:
            i = pa.nulls(len(j), kind)
        value = pa.array(v, mask=n == 0)
        yield pa.RecordBatch.from_arrays([i, j, value], ["i", "j", "v"])
        off = pa.array(np.ones(len(j), bool) if is_null_place else to != column)
        yield pa.RecordBatch.from_arrays([j.filter(off), i.filter(off), value.filter(off)], ["i", "j", "v"])
    if own:
        some = [x for x in own if x is not None]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, kind), pa.array([sum(some) if some else None], pa.float64())], ["i", "j", "v"])
