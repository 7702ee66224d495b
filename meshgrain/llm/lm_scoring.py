"""Language-model scoring with a causal self-attention model over subword ids, in numpy.

Model. The state at a place is tanh(own + attention) with one head over the places before it and itself, biased by
distance. The state opens a gate of CLASSES classes, each a distribution over subword ids; a token's probability is
the gate's mixture of theirs.

Fit. All tasks start from one model, so that their classes agree: stochastic gradient descent on the driver over about
START_DOCS training documents. Then one pass over the whole text of all training documents: each task descends from there over its own
texts, a step for STEP windows, and adds up the classes that it expects of each token. Projections and gate become
the tasks' mean by their windows, an id's embedding the mean by how often each task read it (so that a rare id moves as
far as its own tasks moved it), and the distributions come from the sums of the expected classes. Tasks send their
changes by blocks of ids: what they send, and what the driver gets, is bounded by the vocabulary.

Words. Subwords give a word's probability: its first subword's among those that open a word, the others', and that
the next opens a word. It is mixed with the word's share of all words of the training documents, WHOLE to 1 - WHOLE.

Scoring. A text is its lower-cased words, each with its subwords, and an end. Windows of CONTEXT places overlap; a
window scores its last STRIDE targets, so that every token is scored once, with CONTEXT - STRIDE places before it at
least where the text has them. Windows are batched; places before the text's start are masked.

Counts. That share, and the add-one unigram score over words, the base, need every word's count in the training
documents. Runs of documents send
their distinct words' hashes to hash buckets, packed; the counts of all runs are added up there and come back.

The tokenizer's vocabulary is a public one, at a path that is a parameter; it isn't trained.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textio import BATCH_ROWS, LOWER, NOT_SPACE, Rolling, flat, map_text, runs, sums, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The part of a word's probability that comes from its share of all training words; the rest comes from its subwords.
WHOLE = 0.5
DIM, CLASSES, CONTEXT, STRIDE = 16, 32, 32, 24
#: Training documents to which the common start is fitted, as a bound on their expected number.
START_DOCS = 600
#: Windows in a step of the start and of a task, and the rate of the start's first epoch and of the tasks.
START_STEP, STEP, START_RATE, RATE = 256, 4096, 0.01, 0.003
#: Text bytes in a run of documents, and windows that are worked on at once: their arrays stay in the cache.
RUN, BATCH = 8 << 20, 512
#: Text bytes for each bucket of words.
BUCKET_BYTES = 8 << 20
#: The largest logarithm of a weight or a gate.
CEILING = 60
_U = np.uint64


class Subwords:
    """A public byte-pair vocabulary; words come with a blank before them. Its last id + 1 is the end of a text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.opens = np.zeros(self.end + 1, bool)
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.opens[self.end] = True

    def encode(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin (and the last's end)."""
        if not distinct:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(w.decode("utf-8", "replace") for w in distinct)), np.int32)
        return ids, np.append(np.flatnonzero(self.opens[ids]), len(ids))


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


class Words:
    """The words of a run of texts: hashes of the distinct ones, and each word's place among them."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = LOWER[data]
        self.start, self.end, self.first = words(data, at, NOT_SPACE)
        self.hash, index, self.code = np.unique(Rolling(data).ranges(self.start, self.end), return_index=True, return_inverse=True)
        self._raw, self._index = data.tobytes(), index

    def spelled(self, which: np.ndarray | None = None) -> list[bytes]:
        i = self._index if which is None else self._index[which]
        return [self._raw[a:b] for a, b in zip(self.start[i].tolist(), self.end[i].tolist())]


def spread(ids: np.ndarray, at: np.ndarray, code: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The targets of texts one after the other, an end after each, and where each text begins."""
    n = at[code + 1] - at[code]
    total = np.r_[0, np.cumsum(n)]
    docs = len(first) - 1
    begin = total[first] + np.arange(docs + 1)
    out = np.full(begin[-1], end, np.int32)
    if len(code):
        own = np.repeat(np.arange(docs), np.diff(first))  # one end more for each text before
        place = np.arange(total[-1]) + np.repeat(own, n)
        out[place] = ids[np.arange(total[-1]) + np.repeat(at[code] - total[:-1], n)]
    return out, begin


def windows(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first scored target of each window, and its text."""
    count = -(-np.diff(begin) // STRIDE)
    text = np.repeat(np.arange(len(count)), count)
    return begin[text] + STRIDE * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)), text


class Model:
    """e: embeddings; q, k, v, o, r: projections; bias: by distance; g, gb: gate; t: (ids, classes) distributions.
    scales: running squares of what each was moved by, for the size of the next step."""

    DENSE = ("q", "k", "v", "o", "r", "bias", "g", "gb")

    def __init__(self, vocabulary: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.e = rng.normal(0, 1, (vocabulary, DIM)).astype(np.float32)
        self.q, self.k, self.v, self.o, self.r = (w(DIM, DIM) for _ in range(5))
        self.bias = np.linspace(0, -2, CONTEXT).astype(np.float32)
        self.g, self.gb = w(DIM, CLASSES), np.zeros(CLASSES, np.float32)
        self.t = np.full((vocabulary, CLASSES), 1 / vocabulary, np.float32)
        self.scales = {n: np.full_like(getattr(self, n), 1e-8) for n in ("e", *self.DENSE)}
        self.words = self.ends = 0  # of the training documents; the words with an end each

    def copy(self) -> Model:
        """One that can descend by itself; the distributions are shared."""
        new = object.__new__(Model)
        new.__dict__ = self.__dict__ | {n: getattr(self, n).copy() for n in ("e", *self.DENSE)}
        new.scales = {n: x.copy() for n, x in self.scales.items()}
        return new.ready()

    def dense(self) -> np.ndarray:
        """Projections, bias and gate, one after the other."""
        return np.concatenate([getattr(self, n).ravel() for n in self.DENSE])

    def set_dense(self, values: np.ndarray) -> None:
        for n in self.DENSE:
            old = getattr(self, n)
            setattr(self, n, values[: old.size].reshape(old.shape).astype(old.dtype))
            values = values[old.size :]

    def ready(self) -> Model:
        """Projected embeddings, by which all places are computed; the attention's output projection is taken into the values."""
        self.to_kv = np.concatenate([self.k, self.v @ self.o], 1)
        self.to_qr = np.concatenate([self.q * np.float32(DIM**-0.5), self.r], 1)
        self.kv = np.concatenate([self.e @ self.to_kv, np.ones((len(self.e), 1), self.e.dtype)], 1)
        self.qr = self.e @ self.to_qr
        longest = lambda x: math.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))
        # whether a weight's or a gate's logarithm can be above CEILING at all
        self.steep = longest(self.qr[:, :DIM]) * longest(self.kv[:, :DIM]) + self.bias.max() > CEILING
        self.steep_gate = (np.abs(self.g).sum(0) + self.gb).max() > CEILING
        return self

    def shape(self, target: np.ndarray, begin: np.ndarray, first: np.ndarray, text: np.ndarray):
        """Inputs (windows, CONTEXT), their mask, targets (windows, STRIDE) and theirs."""
        place = first[:, None] + np.arange(STRIDE - CONTEXT, STRIDE)
        lo, hi = begin[text][:, None], begin[text + 1][:, None]
        known = (place >= lo) & (place < hi)
        inputs = np.where(place > lo, target[np.clip(place - 1, 0, len(target) - 1)], len(self.e) - 1)
        return inputs, known, target[np.minimum(place[:, CONTEXT - STRIDE :], len(target) - 1)], known[:, CONTEXT - STRIDE :]

    def distance(self) -> np.ndarray:
        """The bias of each (scored place, place); minus infinity for later places."""
        gap = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)
        return np.where(gap >= 0, self.bias[np.maximum(gap, 0)], -np.inf).astype(np.float32)

    def attend(self, kv, qr, known):
        """The attention's weights, before they are divided by their sums; one over these; the values' means; and the states."""
        a = qr[..., :DIM] @ kv[..., :DIM].transpose(0, 2, 1)
        a += self.distance()
        if self.steep:
            np.minimum(a, CEILING, out=a)
        np.exp(a, out=a)
        cut = np.flatnonzero(~known.all(1))
        a[cut] *= known[cut, None, :]
        c = a @ kv[..., DIM:]  # the last column adds the weights up
        share = 1 / np.maximum(c[..., DIM:], 1e-30)
        mean = c[..., :DIM] * share
        h = mean + qr[..., DIM:]
        np.tanh(h, out=h)
        return a, share, mean, h

    def gate(self, h):
        """The gate of each state, before it is divided by its sum."""
        z = h.reshape(-1, DIM) @ self.g
        z += self.gb
        if self.steep_gate:
            np.minimum(z, CEILING, out=z)
        return np.exp(z, out=z)

    def mixture(self, inputs, known, target):
        """Of each target the gate times its probability in each class; the gate's sum, by which both it and the next are to
        be divided; and the gate's part of the classes' probabilities that a word opens."""
        z = self.gate(self.attend(self.kv.take(inputs, 0), self.qr.take(inputs[:, CONTEXT - STRIDE :], 0), known)[-1])
        total = z @ np.ones(CLASSES, np.float32)
        opens = z @ self.opening
        z *= self.t.take(target.ravel(), 0)
        return z.reshape(*target.shape, CLASSES), total.reshape(target.shape), opens.reshape(target.shape)

    def score(self, target: np.ndarray, begin: np.ndarray, opens: np.ndarray, batch: int = BATCH) -> np.ndarray:
        """log10 of each word's probability, given the text before it, and of each text's end's; `opens` marks the ids
        that begin a word, the end among them."""
        self.opening = (self.t * opens[:, None]).sum(0)
        first, text = windows(begin)
        p, q = np.zeros(len(target)), np.zeros(len(target))
        for i in range(0, len(first), batch):
            f, x = first[i : i + batch], text[i : i + batch]
            inputs, known, t, real = self.shape(target, begin, f, x)
            m, total, o = self.mixture(inputs, known, t)
            place = (f[:, None] + np.arange(STRIDE))[real]
            p[place] = np.log10(np.maximum((m @ np.ones(CLASSES, np.float32) / total)[real], 1e-30))
            q[place] = np.log10(np.maximum((o / total)[real], 1e-30))
        head = np.flatnonzero(opens[target])
        if not len(head):
            return np.zeros(0)
        after = np.append(q[head[1:]], 0.0)
        after[target[head] == len(opens) - 1] = 0.0  # nothing follows an end
        return np.add.reduceat(p, head) - q[head] + after

    def distribute(self, counts: np.ndarray, prior: float = 30.0) -> None:
        """The classes' distributions from expected counts, smoothed by the overall one and that by one."""
        overall = counts.sum(1) + 1e-3
        overall = (overall + 0.5 * overall.sum() / len(overall) / (1 + overall.sum() / len(overall))) if overall.sum() else overall + 1
        overall /= overall.sum()
        t = counts + prior * overall[:, None]
        self.t = (t / t.sum(0)).astype(np.float32)

    def descend(self, inputs, known, target, real, into: dict) -> np.ndarray:
        """Adds the gradient of minus the real targets' log-likelihood to `into`, and gives their expected classes."""
        kv, qr = self.kv.take(inputs, 0), self.qr.take(inputs[:, CONTEXT - STRIDE :], 0)
        a, share, mean, h = self.attend(kv, qr, known)
        z = self.gate(h)
        one = np.ones((CLASSES, 1), z.dtype)
        m = self.t.take(target.ravel(), 0)
        m *= z
        m *= 1 / np.maximum(m @ one, 1e-30)
        z *= 1 / (z @ one)
        z -= m
        z[np.flatnonzero(~real)] = 0
        flat_h = h.reshape(-1, DIM)
        into["g"] += flat_h.T @ z
        into["gb"] += np.ones(len(z), z.dtype) @ z
        slope = flat_h * flat_h
        np.subtract(1, slope, out=slope)
        du = z @ self.g.T
        du *= slope
        # by the sums that the weights are divided by, in the column of the values' ones
        dc = np.empty((*h.shape[:2], DIM + 1), du.dtype)
        np.multiply(du.reshape(h.shape), share, out=dc[..., :DIM])
        mean *= dc[..., :DIM]
        dc[..., DIM] = (mean.reshape(-1, DIM) @ np.full(DIM, -1, du.dtype)).reshape(h.shape[:2])
        ds = dc @ kv[..., DIM:].transpose(0, 2, 1)
        ds *= a
        gap = np.arange(CONTEXT - STRIDE, CONTEXT)[:, None] - np.arange(CONTEXT)
        into["bias"] += np.bincount(np.maximum(gap, 0).ravel(), np.where(gap >= 0, ds.sum(0), 0).ravel(), CONTEXT)
        dkv, dqr = np.empty((*inputs.shape, 2 * DIM), du.dtype), np.empty((*h.shape[:2], 2 * DIM), du.dtype)
        np.matmul(ds.transpose(0, 2, 1), qr[..., :DIM], out=dkv[..., :DIM])
        np.matmul(a.transpose(0, 2, 1), dc[..., :DIM], out=dkv[..., DIM:])
        np.matmul(ds, kv[..., :DIM], out=dqr[..., :DIM])
        dqr[..., DIM:] = du.reshape(h.shape)
        x = self.e.take(inputs, 0)
        into["kv"] += x.reshape(-1, DIM).T @ dkv.reshape(-1, 2 * DIM)
        into["qr"] += x[:, CONTEXT - STRIDE :].reshape(-1, DIM).T @ dqr.reshape(-1, 2 * DIM)
        dx = (dkv.reshape(-1, 2 * DIM) @ self.to_kv.T).reshape(x.shape)
        dx[:, CONTEXT - STRIDE :] += (dqr.reshape(-1, 2 * DIM) @ self.to_qr.T).reshape(*h.shape)
        _add(into["e"], inputs.ravel(), dx.reshape(-1, DIM))
        into["n"] += int(real.sum())
        return m.take(np.flatnonzero(real), 0)

    def gradient(self) -> dict:
        """An empty one, for descend()."""
        kv = np.zeros((DIM, 2 * DIM))
        return {"e": np.zeros(self.e.shape, self.e.dtype), "kv": kv, "qr": kv.copy(), "bias": np.zeros(CONTEXT), "g": np.zeros(self.g.shape), "gb": np.zeros(CLASSES), "n": 0}

    def by_projection(self, into: dict) -> dict:
        """The gradient by each dense array."""
        vo = into["kv"][:, DIM:]
        own = {"k": into["kv"][:, :DIM], "v": vo @ self.o.T, "o": self.v.T @ vo}
        return own | {"q": into["qr"][:, :DIM] * DIM**-0.5, "r": into["qr"][:, DIM:], "bias": into["bias"], "g": into["g"], "gb": into["gb"]}

    def step(self, into: dict, rate: float) -> None:
        """Moves all against the gradient's mean over its targets, by running scales, and empties it."""
        n = max(1, into["n"])
        for name, grad in self.by_projection(into).items():
            grad, s = (grad / n).astype(np.float32), self.scales[name]
            s *= 0.99
            s += 0.01 * grad * grad
            setattr(self, name, getattr(self, name) - rate * grad / np.sqrt(s))
        rows = np.flatnonzero(into["e"].any(1))
        de, s = into["e"][rows] / n, self.scales["e"]
        s[rows] += de * de
        self.e[rows] -= rate * 10 * de / np.sqrt(s[rows])
        for x in into.values():
            if isinstance(x, np.ndarray):
                x[:] = 0
        into["n"] = 0
        self.ready()


def _add(into: np.ndarray, row: np.ndarray, value: np.ndarray) -> None:
    """into[row] += value, rows repeated."""
    if not len(row):
        return
    if len(into) <= 1 << 16:
        row = row.astype(np.uint16)  # sorted by digits
    order = np.argsort(row, kind="stable")
    r = row[order]
    head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    into[r[head]] += np.add.reduceat(value.take(order, 0), head, axis=0)


def train(target: np.ndarray, begin: np.ndarray, vocabulary: int, *, epochs: int = 6, batch: int = START_STEP, rate: float = START_RATE, seed: int = 5) -> Model:
    """Fits a model to texts (targets as of spread()): among the ids that occur there, and the others are as they begin."""
    model = Model(vocabulary, seed)
    ids, target = np.unique(np.append(target, vocabulary - 1), return_inverse=True)  # the end stays the last
    target = target[:-1].astype(np.int32)
    small = Model(len(ids), seed)
    small.e = model.e[ids]
    rng = np.random.default_rng(seed)
    seen = np.bincount(target, minlength=len(ids)).astype(np.float64)
    counts = seen[:, None] * rng.dirichlet(np.full(CLASSES, 0.3), len(ids))
    small.ready().distribute(counts)
    first, text = windows(begin)
    grad = small.gradient()
    fresh, since = np.zeros_like(counts), 0
    for epoch in range(epochs):
        order = rng.permutation(len(first))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            inputs, known, t, real = small.shape(target, begin, first[pick], text[pick])
            _add(fresh, t[real], small.descend(inputs, known, t, real, grad))
            small.step(grad, rate * (1 - 0.8 * epoch / epochs))
            since += 1
            if since == 16:  # stepwise expectation: the older, the less it counts
                keep = 0.85
                counts = keep * counts + (1 - keep) * fresh * (seen.sum() / max(1.0, fresh.sum()))
                small.distribute(counts)
                fresh[:], since = 0, 0
    model.set_dense(small.dense())
    model.e[ids], model.scales["e"][ids] = small.e, small.scales["e"]
    model.scales |= {n: small.scales[n] for n in Model.DENSE}
    whole = np.zeros((vocabulary, CLASSES))
    whole[ids] = counts
    model.distribute(whole)
    return model.ready()


class Descent:
    """A task's own descent from the common start over the texts that it reads."""

    def __init__(self, start: Model):
        self.start, self.model = start, start.copy()
        self.grad, self.since, self.windows = self.model.gradient(), 0, 0
        vocabulary = len(start.e)
        self.expected = np.zeros((vocabulary, CLASSES), np.float32)
        self.read = np.zeros(vocabulary, np.int64)  # how often each id was an input that a scored place could see

    def learn(self, target: np.ndarray, begin: np.ndarray, use: np.ndarray, batch: int = BATCH) -> None:
        """Descends over the texts in the mask `use`, and adds up the expected classes of their targets."""
        first, text = windows(begin)
        first, text = first[use[text]], text[use[text]]
        for i in range(0, len(first), batch):
            inputs, known, t, real = self.model.shape(target, begin, first[i : i + batch], text[i : i + batch])
            _add(self.expected, t[real], self.model.descend(inputs, known, t, real, self.grad))
            self.read += np.bincount(inputs[known], minlength=len(self.read))
            self.since += len(inputs)
            self.windows += len(inputs)
            if self.since >= STEP:
                self.step()

    def step(self) -> None:
        # a step over few windows, as a task's last, moves the less
        self.model.step(self.grad, RATE * min(1.0, self.since / STEP))
        self.since = 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids that were met, with WIDTH numbers each: expected classes, the embedding's change times how often it was
        read, and that; and the change of what is dense times the windows, with these at the end."""
        if self.since:
            self.step()
        ids = np.flatnonzero((self.read > 0) | self.expected.any(1))
        n = self.read[ids, None].astype(np.float32)
        moved = np.concatenate([self.expected[ids], (self.model.e[ids] - self.start.e[ids]) * n, n], 1)
        return ids, moved, np.append((self.model.dense() - self.start.dense()) * np.float32(self.windows), np.float32(self.windows))


def _packed(arrays: dict) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(x.max(initial=0)))


def _coded(w: Words, ids: np.ndarray, at: np.ndarray, held: np.ndarray, buckets: int) -> bytes:
    """What a run of texts is scored by: each word's place among the distinct ones, with equal bytes of these beside each other; their subwords
    and hash buckets; each text's first word, and who is held out."""
    code = _narrow(w.code)
    planes = code.view(np.uint8).reshape(len(code), code.itemsize).T
    return _packed({"code": planes, "ids": _narrow(ids), "count": _narrow(np.diff(at)), "bucket": _narrow(w.hash % _U(buckets)), "first": w.first, "held": held})


def _decoded(raw: bytes) -> tuple[np.ndarray, ...]:
    """code, ids, at, bucket, first, held: see _coded()."""
    import io

    x = np.load(io.BytesIO(raw))
    planes = np.ascontiguousarray(x["code"].T)
    code = planes.view(f"u{planes.shape[1]}").ravel().astype(np.int64)
    return code, x["ids"].astype(np.int32), np.append(0, np.cumsum(x["count"], dtype=np.int64)), x["bucket"].astype(_U), x["first"], x["held"]


def _held_out(id_col: str) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(7)) == 2


def begin_fit(training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, start_docs: int = START_DOCS) -> Model:
    """The common start: see the module's text. Null counts as empty. Without documents every id is as likely as another."""
    spark = training.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    size = subwords(vocabulary).end + 1
    texts = training.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    share = min(1.0, start_docs / max(1, texts.count()))
    sample = texts.filter(F.pmod(F.xxhash64("id", "body", F.lit("lm")), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))

    def make():
        def of(part):
            w = Words(*flat(part.column("body")))
            sw = subwords(vocabulary)
            target, begin = spread(*sw.encode(w.spelled()), w.code, w.first, sw.end)
            return [pa.array([target[a:b].astype(np.uint16 if size <= 1 << 16 else np.int32).tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())]

        return of

    rows = sorted(map_text(sample, "body", [], "ids binary", make).toArrow().column("ids").to_pylist())
    ids = [np.frombuffer(r, np.uint16 if size <= 1 << 16 else np.int32) for r in rows]
    target = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
    return train(target, np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int64), size)


#: What a pass over the texts gives. kind 0: a run's distinct words in a hash bucket `key` (a: hashes, b: their numbers in
#: training documents); 1: the run itself (a: as _coded(), compressed, of `size` bytes), from which it is scored without being cut into words again;
#: 2: of a block `key` of ids what a task learned (a: places in the block, b: WIDTH numbers for each); block DENSE has the
#: changes of projections, bias and gate, WIDTH to a row; 3: numbers of words and texts in training documents (b).
_POSTED = "kind int, key long, blob long, a binary, b binary, size long, ids array<string>"
_RUN = "blob long, key long, a binary, b binary, size long, ids array<string>"
_SUMS = "key long, a binary, b binary"
_SCORED = "id string, held_out boolean, n_tokens long, n_known long, logs double, score double, train long, distinct long"
#: Ids in a block of what tasks learned, numbers for each, and the block of what doesn't belong to an id.
BLOCK, WIDTH, DENSE = 4096, CLASSES + DIM + 1, -1


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _post(batches, vocabulary: str, buckets: int, begun):
    """The pass over the texts: see _POSTED."""
    task = TaskContext.get().partitionId()
    blob = (task << 24) - 1
    sw, descent, total = subwords(vocabulary), None, np.zeros(2, np.int64)
    for batch in batches:
        for part in runs(batch, "body", RUN):
            blob += 1
            data, at = flat(part.column("body"))
            w = Words(data, at)
            held = np.array(part.column("held_out").to_pylist(), bool)
            ids, at = sw.encode(w.spelled())
            target, begin = spread(ids, at, w.code, w.first, sw.end)
            descent = descent or Descent(begun.value)
            descent.learn(target, begin, ~held)
            in_training = np.repeat(~held, np.diff(w.first))
            total += in_training.sum(), (~held).sum()
            n = np.bincount(w.code[in_training], minlength=len(w.hash))
            bucket, order = _dealt(w.hash, buckets)
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            raw = _coded(w, ids, at, held, buckets)
            rows = [(1, None, blob, pa.compress(raw, "zstd", asbytes=True), None, len(raw), part.column("id").to_pylist())]
            for a, z in zip(heads, np.append(heads[1:], len(bucket)) if len(heads) else []):
                rows.append((0, int(bucket[a]), blob, w.hash[order[a:z]].tobytes(), n[order[a:z]].astype(np.uint32).tobytes(), None, None))
            yield _table(rows, _POSTED)
    rows = [(3, int(total[0]), task, None, None, int(total[1]), None)]
    if descent:
        ids, moved, dense = descent.rows()
        for k in np.unique(ids // BLOCK).tolist():
            mine = ids // BLOCK == k
            rows.append((2, k, task, (ids[mine] % BLOCK).astype(np.int32).tobytes(), moved[mine].tobytes(), None, None))
        lines = -(-len(dense) // WIDTH)
        dense = np.pad(dense, (0, lines * WIDTH - len(dense))).astype(np.float32)
        rows.append((2, DENSE, task, np.arange(lines, dtype=np.int32).tobytes(), dense.tobytes(), None, None))
    yield _table(rows, _POSTED)


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A run's words by bucket: each one's bucket, and its place in `hashes`."""
    bucket = (hashes % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], order


def _add_up(table: pa.Table) -> pa.Table:
    """The sums of what tasks learned of a block."""
    found, seen = np.zeros((BLOCK, WIDTH)), np.zeros(BLOCK, bool)
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
        i = np.frombuffer(a, np.int32)
        found[i] += np.frombuffer(b, np.float32).reshape(-1, WIDTH)
        seen[i] = True
    i = np.flatnonzero(seen)
    return pa.Table.from_batches([_table([(table.column("key")[0].as_py(), i.astype(np.int32).tobytes(), found[i].astype(np.float32).tobytes())], _SUMS)])


def finish_fit(model: Model, posted: DataFrame) -> Model:
    """The model of all training texts from the common start and the table of the pass. Tasks' sums are added up in two
    steps, so that no group has more than a part of the tasks; the driver gets one row for each block."""
    parts = posted.filter("kind = 2").withColumn("part", F.pmod("blob", F.lit(512)))
    part = parts.groupBy("key", "part").applyInArrow(_add_up, _SUMS)
    sums_ = part.groupBy("key").applyInArrow(_add_up, _SUMS).toArrow()
    counts = np.zeros((len(model.e), CLASSES))
    for key, a, b in zip(*(sums_.column(x).to_pylist() for x in ("key", "a", "b"))):
        found = np.frombuffer(b, np.float32).reshape(-1, WIDTH)
        if key == DENSE:
            own = model.dense()
            model.set_dense(own + found.ravel()[: len(own)] / max(1.0, found.ravel()[len(own)]))
        else:
            i = np.frombuffer(a, np.int32) + key * BLOCK
            counts[i] = found[:, :CLASSES]
            model.e[i] += found[:, CLASSES:-1] / np.maximum(found[:, -1:], 1)
    if counts.any():
        model.distribute(counts)
    model.ready()
    t = posted.filter("kind = 3").agg(F.sum("key"), F.sum("size")).first()
    model.ends = t[1] or 0
    model.words = (t[0] or 0) + model.ends
    return model


def passed(docs: DataFrame, held_out: F.Column, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, start_docs: int = START_DOCS) -> tuple[Model, DataFrame, int]:
    """The model that is learned from what `held_out` leaves, the table of the pass over all texts, and its number of
    hash buckets. That table has the texts in runs, as words' places, so that they and their counts meet again without another pass."""
    spark = docs.sparkSession
    begun = begin_fit(docs.filter(~held_out), id_col=id_col, text_col=text_col, vocabulary=vocabulary, start_docs=start_docs)
    volume = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(12, math.ceil(volume / BUCKET_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS * 8)
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"), held_out.alias("held_out"))
    shared = spark.sparkContext.broadcast(begun)
    posted = written(rows.mapInArrow(lambda it: _post(it, vocabulary, buckets, shared), _POSTED), "runs")
    return finish_fit(begun, posted), posted, buckets


def fit(training: DataFrame, **options) -> Model:
    """Trains on all documents of a table: see the module's text."""
    return passed(training, F.lit(False), **options)[0]


def _total(table: pa.Table) -> pa.Table:
    """The counts over all runs of a bucket's words, for each run in its order."""
    hashes = [np.frombuffer(x, _U) for x in table.column("a").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("b").to_pylist()])
    u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(inverse, n).astype(np.int64)
    back = count[inverse].astype(np.uint32 if count.max() < 1 << 32 else np.int64)
    key = table.column("key")[0].as_py()
    rows, at = [], 0
    for i, (blob, h) in enumerate(zip(table.column("blob").to_pylist(), hashes)):
        rows.append((blob, key, back[at : at + len(h)].tobytes(), None, int((count > 0).sum()) if i == 0 else 0, None))
        at += len(h)
    return pa.Table.from_batches([_table(rows, _RUN)])


def _mixed(count: np.ndarray, total: int, score: np.ndarray) -> np.ndarray:
    """log10 of the words' mixed probabilities: counts among `total`, and log10 by subwords, which may be far below any float."""
    with np.errstate(divide="ignore"):
        share = np.log(WHOLE * count / max(1, total))
    return np.logaddexp(share, math.log(1 - WHOLE) + math.log(10) * score) / math.log(10)


def _scored(table: pa.Table, vocabulary: str, buckets: int, model, total: int, ends: int) -> pa.Table:
    """A run's documents, with the logarithms of their words' counts, and of their mixed probabilities, added up; total
    and ends: words and texts of the training documents. `train` and `distinct` are the run's
    part of the totals, on its first document."""
    run = next(r for r in table.to_pylist() if r["ids"] is not None)
    code, subs, at, bucket, first, held = _decoded(pa.decompress(run["a"], run["size"], "zstd", asbytes=True))
    ids, sw = run["ids"], subwords(vocabulary)
    target, begin = spread(subs, at, code, first, sw.end)
    score = model.value.score(target, begin, sw.opens)
    bucket, order = _dealt(bucket, buckets)
    c, distinct = np.zeros(len(order), np.int64), 0
    for key, count, share, names in zip(*(table.column(x).to_pylist() for x in ("key", "a", "size", "ids"))):
        if names is None:
            lo, hi = np.searchsorted(bucket, [key, key + 1])
            c[order[lo:hi]] = np.frombuffer(count, np.uint32 if len(count) == 4 * (hi - lo) else np.int64)
            distinct += share
    c = c[code]
    n = np.diff(first)
    # words and ends stand one after the other in `score`
    own = np.repeat(np.arange(len(n)), n)
    mixed = _mixed(c, total, score[np.arange(len(code)) + own])
    ends_at = first[1:] + np.arange(len(n))
    score = sums(mixed, first) + _mixed(np.full(len(n), ends), total, score[ends_at])
    train = np.zeros(len(n), np.int64)
    share = np.zeros(len(n), np.int64)
    if len(n):
        train[0], share[0] = (n + 1)[~held].sum(), distinct
    cols = (ids, held, n + 1, sums((c > 0).astype(np.int64), first), sums(np.log10(c + 1.0), first), score, train, share)
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=[x.split()[0] for x in _SCORED.split(", ")])


def score(docs: DataFrame, held_out: F.Column, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, start_docs: int = START_DOCS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document; trained on those that
    `held_out` (a column of docs) leaves.

    Null counts as empty: a text of its end alone. Repeated rows are scored, and learned from, each. The end is a word
    of the base; n_known counts it if any document is in training.
    """
    fitted, posted, buckets = passed(docs, held_out, id_col=id_col, text_col=text_col, vocabulary=vocabulary, start_docs=start_docs)
    total, ends = fitted.words, fitted.ends
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    counted = posted.filter("kind = 0").select("key", "blob", "a", "b").groupBy("key").applyInArrow(_total, _RUN)
    own = posted.filter("kind = 1").select("blob", F.lit(None).cast("long").alias("key"), "a", "b", "size", "ids")
    scored = counted.unionByName(own).groupBy("blob").applyInArrow(lambda t: _scored(t, vocabulary, buckets, model, total, ends), _SCORED)
    table = written(scored, "scores")
    t = table.agg(F.sum("train"), F.sum("distinct")).first()
    n, v = t[0] or 0, (t[1] or 0) + (ends > 0)
    kind = docs.schema[id_col].dataType.simpleString()
    base = F.col("logs") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return table.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op4_attention_lm(spark, sf_dir: str) -> DataFrame:
    """All whole texts; learned from documents whose crc32(doc_id) mod 7 isn't 2."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), _held_out("doc_id"))
