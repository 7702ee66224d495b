"""Language identification: averaged hashed subword embeddings and a linear softmax, by stochastic gradient descent.

A text's subwords are its 3- and 4-byte strings, A-Z lower-cased, with a blank for everything in ASCII that isn't a
letter. Each is hashed to one of BUCKETS embeddings; the mean goes through a linear layer and a softmax. The
temperature is fitted on rows kept out of the training, and so is the confidence below which a prediction is
rejected: half as a rule, less where that would reject a row of theirs that was right.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import LOWER, flat, map_text

BUCKETS = 8192
UNKNOWN = "und"
#: The training sample's bound: rows in all, dealt evenly over the languages.
SAMPLE_ROWS = 1200

_PLAIN = np.where((LOWER >= 0x61) & (LOWER <= 0x7A) | (LOWER >= 0x80), LOWER, 0x20).astype(np.uint32)


def bags(column: pa.Array) -> np.ndarray:
    """The number of each text's subwords in each bucket."""
    data, at = flat(column)
    n, docs = len(data), len(at) - 1
    out = np.zeros((docs, BUCKETS), np.float32)
    if n < 3:
        return out
    c = _PLAIN[data]
    row = np.repeat(np.arange(docs, dtype=np.int64) * BUCKETS, np.diff(at))
    lost = docs * BUCKETS  # where strings go that cross the end of a text, or have blanks alone
    total = np.zeros(lost + 1, np.int64)
    gram = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    for k in (3, 4):
        if k == 4:
            if n < 4:
                break
            gram = (gram[:-1] << np.uint32(8)) | c[3:]
        bucket = (gram * np.uint32(2654435761 if k == 3 else 2246822519)) >> np.uint32(32 - 13)
        index = row[: len(gram)] + bucket
        index[gram == (0x202020 if k == 3 else 0x20202020)] = lost
        over = at[1:, None] - np.arange(1, k)
        index[over[(over >= at[:-1, None]) & (over < len(gram))]] = lost
        total += np.bincount(index, minlength=lost + 1)
    out[:] = total[:-1].reshape(docs, BUCKETS)
    return out


class Model(NamedTuple):
    """langs in order; table: each bucket's logits (embedding x linear layer, at the fitted temperature)."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    reject: float

    def probabilities(self, bag: np.ndarray) -> np.ndarray:
        z = bag @ self.table / np.maximum(bag.sum(1, keepdims=True), 1) + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(bag: np.ndarray, lang: list[str], *, dim: int = 16, epochs: int = 30, rate: float = 0.5, seed: int = 3) -> Model:
    """Fits embeddings and softmax on three quarters of the rows, temperature and rejection on the rest. Turns the counts
    in `bag` into shares."""
    langs = sorted(set(lang))
    y = np.searchsorted(langs, lang)
    x = bag
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 4 == 3
    fit, kept_out = np.flatnonzero(~aside), np.flatnonzero(aside)
    e = rng.normal(0, 1, (BUCKETS, dim)).astype(np.float32)
    w, b = rng.normal(0, 0.3, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for i in range(0, len(order), 32):
            rows = order[i : i + 32]
            h = x[rows] @ e
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ w.T
            w -= step * (h.T @ p)
            b -= step * p.sum(0)
            e -= 100 * step * (x[rows].T @ back)  # each bucket has about a thousandth of a text
    heat, reject = 1.0, 0.5
    if len(kept_out):
        z = x[kept_out] @ e @ w + b

        def chances(t):
            q = np.exp((z - z.max(1, keepdims=True)) / t)
            return q / q.sum(1, keepdims=True)

        right = (np.arange(len(kept_out)), y[kept_out])
        heat = min(np.geomspace(0.2, 5, 60), key=lambda t: -np.log(np.maximum(chances(t)[right], 1e-12)).mean())
        p = chances(heat)
        good = p.argmax(1) == right[1]
        reject = min(0.5, 0.9 * float(p[good].max(1).min())) if good.any() else 0.0
    return Model(langs, (e @ w / heat).astype(np.float32), (b / heat).astype(np.float32), reject)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Trains on the rows with a text and a language: all, or of each language a hashed share of about
    sample_rows / languages rows. Whole texts become bags of subwords on the executors. None without such rows."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_rows / len(counts) / n))])
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(chance < share[F.col(lang_col)])

    def make():
        def of(part):
            bag = bags(part.column("body"))
            which = [np.flatnonzero(b) for b in bag]
            return [pa.array(which, pa.list_(pa.int32())), pa.array([b[i] for b, i in zip(bag, which)], pa.list_(pa.float32()))]

        return of

    got = map_text(sample, text_col, [id_col, lang_col], "at array<int>, n array<float>", make).toArrow()
    ids = np.array([-1 if i is None else i for i in got.column(id_col).to_pylist()])
    langs = got.column(lang_col).to_pylist()
    at, n = (got.column(c).combine_chunks() for c in ("at", "n"))
    length = np.diff(at.offsets.to_numpy())
    order = np.lexsort((length, ids))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    bag = np.zeros((len(ids), BUCKETS), np.float32)
    bag[np.repeat(place, length), at.flatten().to_numpy()] = n.flatten().to_numpy()
    del got, at, n
    return train(bag, [langs[i] for i in order])


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns `keep`, and lang_pred, score (the probability, 0 to 1), rejected (boolean) for every row.

    A null text and one without a letter is `und`, with score 0, and rejected; so is every text if there
    was nothing to learn from. A rejected text with letters keeps its likeliest language in lang_pred.
    """
    letters = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))

    def make():
        def of(part):
            has = np.array(part.column("letters").to_pylist(), bool)
            if model is None:
                has[:] = False
                lang, score = [UNKNOWN] * len(has), np.zeros(len(has))
            else:
                p = model.probabilities(bags(part.column("body")))
                score = np.where(has, p.max(1), 0.0).astype(np.float64)
                lang = [model.langs[k] if h else UNKNOWN for k, h in zip(p.argmax(1), has)]
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~has | (score < (model.reject if model else 1)), pa.bool_())]

        return of

    return map_text(docs, text_col, keep, "lang_pred string, score double, rejected boolean", make, more={"letters": letters})


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every whole text; learned from documents whose crc32(doc_id) mod 4 isn't 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
