"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are cut into bins. Boosting goes round the features; in every turn a shallow tree (four
leaves) over one feature's bins is fitted to the gradient of the log loss, and its leaves are added to the feature's
lookup table. Then the pairs whose interaction explains most of what is left are boosted likewise over two-way tables.
A score is a sum of table look-ups through a sigmoid.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textio import LOWER, NOT_SPACE, Rolling, flat, map_text, owner, sums, words

#: The bound of the training sample.
SAMPLE_ROWS = 20_000
BINS = 48
PAIR_BINS = 12

FEATURES = (
    "bytes", "upper", "lower", "digits", "stops", "commas", "exclamations", "symbols", "bars", "line_ends", "high", "other",
    "words", "word_bytes", "short_words", "distinct_words", "commonest_word", "distinct_lines", "line_words",
)

_CLASSES = np.zeros((256, 11), np.float32)
for _j, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".?;:", ",", "!", "#$%&*@^~_+=<>\\/", "|", "\n")):
    _CLASSES[[ord(c) for c in _chars], _j] = 1
_CLASSES[0x80:, 9] = 1
_CLASSES[:, 10] = (_CLASSES.sum(1) == 0) & NOT_SPACE


def _repeats(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's keys, how many distinct ones there are and how often the commonest occurs."""
    docs = len(first) - 1
    who = owner(first)
    order = np.lexsort((key, who))
    k, d = key[order], who[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, d[head], np.diff(np.append(head, len(k))))
    return np.bincount(d[head], minlength=docs), top


def measure(column: pa.Array) -> np.ndarray:
    """The features of each text, a row each; zeros for an empty one."""
    data, at = flat(column)
    docs = len(at) - 1
    n = np.diff(at)
    who = np.repeat(np.arange(docs, dtype=np.int64) << 8, n)
    seen = np.bincount(who + data, minlength=docs << 8).reshape(docs, 256)
    share = seen @ _CLASSES / np.maximum(n, 1)[:, None]
    low = LOWER[data]
    roll = Rolling(low)
    start, end, first = words(low, at, NOT_SPACE)
    count = np.diff(first)
    distinct, top = _repeats(roll.ranges(start, end), first)
    some = np.maximum(count, 1)
    not_end = np.ones(256, bool)
    not_end[10] = False
    ls, le, lf = words(low, at, not_end)
    lines = np.diff(lf)
    distinct_lines, _ = _repeats(roll.ranges(ls, le), lf)
    return np.column_stack([
        np.log1p(n), share, np.log1p(count), sums(end - start, first) / some, sums((end - start <= 3).astype(np.int64), first) / some,
        distinct / some, top / some, distinct_lines / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1)),
    ]).astype(np.float64)


class Model(NamedTuple):
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised bin additions."""
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def _cut(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, least: float = 5.0) -> np.ndarray:
    """The leaf value at each bin: greedy splits of the bins' gradient sums g and Hessian sums h."""
    parts = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = np.where(np.minimum(ch[m] - ch[a], ch[b] - ch[m]) >= least * 0.05, worth(a, m) + worth(m, b) - worth(a, b), 0)
                if gain.max() > best[0]:
                    best = (gain.max(), (a, int(m[gain.argmax()]), b))
        if best[1] is None:
            break
        a, m, b = best[1]
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _plane(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree over a two-way table: the better first axis, split once, and each half split on the other."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        rows = _tree(a.sum(1), b.sum(1), 2)
        out, gain = np.zeros_like(a), 0.0
        for value in np.unique(rows):
            half = rows == value
            line = _tree(a[half].sum(0), b[half].sum(0), 2)
            out[half] = line
            gain += (line * a[half].sum(0)).sum()
        if gain > best[0]:
            best = (gain, out.T if turned else out)
    return best


def train(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 30) -> Model:
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    edges = [_cut(v, BINS) for v in x.T]
    coarse = [_cut(v, PAIR_BINS) for v in x.T]
    code = [np.searchsorted(e, v, "right") for e, v in zip(edges, x.T)]
    wide = [np.searchsorted(e, v, "right") for e, v in zip(coarse, x.T)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    bias = np.log(p / (1 - p))
    z = np.full(len(y), bias)

    def gradient():
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, c in enumerate(code):
            g, h = gradient()
            step = rate * _tree(np.bincount(c, g, len(tables[j])), np.bincount(c, h, len(tables[j])))
            tables[j] += step
            z += step[c]

    def planes(a, b):
        g, h = gradient()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat_ = wide[a] * shape[1] + wide[b]
        return _plane(np.bincount(flat_, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat_, h, shape[0] * shape[1]).reshape(shape))

    f = x.shape[1]
    chosen = sorted(((a, b) for a in range(f) for b in range(a)), key=lambda ab: -planes(*ab)[0])[:pairs] if len(y) else []
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(chosen):
            step = rate * planes(a, b)[1]
            pair_tables[k] += step
            z += step[wide[a], wide[b]]
    return Model(edges, tables, chosen, coarse, pair_tables, float(bias))


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every whole text; null counts as empty.

    Repeated rows have a row each, equal texts equal features, whatever the other columns are; an empty table stays empty.
    """

    def make():
        def of(part):
            return [pa.array(list(measure(part.column("body"))), pa.list_(pa.float64()))]

        return of

    return map_text(docs, text_col, [id_col], "x array<double>", make)


def fit(features: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on the documents with a label that isn't null: all, or a hashed share of about sample_rows.
    A document with several labels counts with each. Without any, every score is one half."""
    known = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("double").alias("y"))
    share = min(1.0, sample_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("quality")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = features.join(known, id_col).select(id_col, "x", "y").toArrow()
    if not len(rows):
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    order = np.lexsort((rows.column("y").to_numpy(), rows.column(id_col).to_numpy()))
    return train(np.array(rows.column("x").to_pylist())[order], rows.column("y").to_numpy()[order])


def score(features: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every row of the feature table: 0 to 1, equal for equal features, so ties stay ties. A model without
    training rows scores all alike; repeated rows come out as often as they go in; an empty table stays empty."""

    def run(batches):
        for b in batches:
            flat_ = b.column("x").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(flat_.reshape(len(b), -1)), pa.float64())], names=["k", "score"])

    kind = features.schema[id_col].dataType.simpleString()
    return features.select(F.col(id_col).alias("k"), "x").mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(3)) == 1


def op6_additive_quality(spark, sf_dir: str) -> DataFrame:
    """Every whole text; learned from labelled rows whose crc32(doc_id) mod 3 isn't 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    features = written(feature_table(docs), "quality")
    model = fit(features, labels.filter(~held_out()))
    return score(features, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
