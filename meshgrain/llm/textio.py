"""Arrow text columns as flat byte arrays, with vectorised word splitting and hashing.

Every helper works on whole texts. A null text counts as empty. Word classes are byte classes, which is
exact for UTF-8: all bytes of a multi-byte character are 0x80 or more.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Texts are worked on in runs of rows of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 2 << 20
#: Rows in an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 256

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: The class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _frugal() -> None:
    """Lets a Spark worker's allocator give large arrays back at once: else it keeps the most that it ever used, and several idle
    workers share a machine. Nothing changes in any other process, or without glibc."""
    if TaskContext.get() is None:
        return
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # arrays from 4 MB on are mapped, and unmapped when they go
        libc.mallopt(-1, 16 << 20)  # free memory at the heap's end beyond 16 MB goes back
    except OSError:
        return
    pa.set_memory_pool(pa.system_memory_pool())


_frugal()
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, RUN_BYTES + (RUN_BYTES >> 2))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(m, base & _MASK, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any byte ranges of a text: a polynomial with one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(BYTE[data] * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each position."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs(batch: pa.RecordBatch, name: str, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `limit` bytes; one row at least."""
    _, at = flat(batch.column(name))
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of class `kind`, and for each text its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = kind[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[0] = False
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at)


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word, from words()' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each text's values; 0 for a text without any."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ... instead of its own, and each one's new name: what is added can't clash with them.
    toDF(*df.columns) of the same columns brings the names back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def free(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as it takes to be none of those."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def map_text(df: DataFrame, text_col: str, keep: list[str], out: str, make: Callable[[], Callable], limit: int = RUN_BYTES, more: dict | None = None) -> DataFrame:
    """Adds columns that a function makes from whole texts, in Arrow batches.

    make() runs once in each task and returns a function from a record batch with column `body` (and one
    for each of `more`, name to Column) to arrays for the columns of the DDL string `out`, one row for
    each row. The columns `keep` are carried along under private names, so theirs may be any; where one has the
    name of an added column, the added one gets an underscore before it. The session's Arrow batches are held to
    BATCH_ROWS rows.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    carried = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    inner = df.select(*carried, F.col(f"`{text_col}`").cast("string").alias("body"), *[c.alias(n) for n, c in (more or {}).items()])
    made = _parse_datatype_string(out)
    kept = inner.columns[: len(keep)]
    schema = StructType([StructField(f.name, f.dataType, True) for f in [*inner.schema.fields[: len(keep)], *made.fields]])

    def run(batches):
        f = make()
        for batch in batches:
            for part in runs(batch, "body", limit):
                got = f(part)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *got], names=[*kept, *made.names])

    return inner.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(n).alias(free(n, keep)) for n in made.names])
