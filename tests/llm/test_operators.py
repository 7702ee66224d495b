"""The operators on odd rows, on empty tables, and against brute force on a small table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from meshgrain.llm import components, decontamination, language, line_dedup, lm_scoring, media, mixing, quality, sharding, shingle_join, suffix_dedup, textio
from meshgrain.llm.queries import QUERIES

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().translate(bytes(range(256)).lower())


# --- words


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["A b\tc", None, "", "  x ", "é É", "abc" * 1000]
    data, at = textio.flat(pa.array(texts))
    start, end, first = textio.words(data, at, textio.NOT_SPACE)
    got = [[data[a:b].tobytes() for a, b in zip(start[i:j], end[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [SPACE.findall((t or "").encode()) for t in texts]
    r = textio.Rolling(np.frombuffer(b"abcXabc", np.uint8))
    h = r.ranges(np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]


# --- 1 sharding


def test_tree_moves_only_into_the_new_shard(spark):
    tree = sharding.planned()
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    out = sharding.assign(sharding.assign(df, "doc_id", tree), "doc_id", sharding.grown(tree), "grown_").toPandas()
    moved = out[out.shard != out.grown_shard]
    assert set(moved.grown_shard) == {24} and 120 < len(moved) < 290
    assert out.shard.value_counts().between(140, 280).all() and set(out.shard) == set(range(24))
    assert ((out["shard"] // 4 == out["rack"]) & (out["rack"] // 3 == out["region"])).all()
    # a heavier rack draws keys from everywhere, but moves none between racks of other regions
    heavy = [s._replace(weight=3.0) if s.rack == 5 else s for s in tree]
    again = sharding.assign(df, "doc_id", heavy).toPandas().set_index("doc_id")
    first = out.set_index("doc_id")
    stay = (first.region == 0) & (again.region == 0)
    assert (first.shard[stay] == again.shard[stay]).all()
    with pytest.raises(ValueError):
        sharding.assign(df, "doc_id", [])


def test_tree_draws_match_a_plain_version(spark):
    xxhash = pytest.importorskip("xxhash")

    def draw(key, tag, weight):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
        h = xxhash.xxh64_intdigest(tag.encode(), seed=h) >> 11
        return -math.log((h + 0.5) / 2**53) / weight

    tree = sharding.planned()
    got = {r.doc_id: r.shard for r in sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), "doc_id", tree).collect()}
    for key, shard in got.items():
        region = min((0, 1), key=lambda r: draw(key, f"region{r}", 12))
        rack = min({s.rack for s in tree if s.region == region}, key=lambda a: draw(key, f"rack{a}", 4))
        assert shard == min((s.shard for s in tree if s.rack == rack), key=lambda s: draw(key, f"shard{s}", 1))


def test_slots_are_gapless(odd, empty):
    t = sharding.assign(odd.select("doc_id", "size"), "doc_id", sharding.planned())
    out = sharding.slots(t, "shard", ["doc_id"]).toPandas()
    assert len(out) == 12
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.slots(sharding.assign(empty, "doc_id", sharding.planned()), "shard", ["doc_id"]).count() == 0


def test_tree_query_against_draws_by_hand(spark, sf, docs):
    """Every document goes down the tree by the least exponential draw, and slots have no gaps."""
    import xxhash

    got = QUERIES["op1_hash_tree"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and set(got.law) == {"key"}

    def least(key, level, weights):
        first = xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42)
        draw = {c: -math.log(((xxhash.xxh64_intdigest(f"{level}{c}".encode(), first) >> 11) + 0.5) / (1 << 53)) / w for c, w in weights.items()}
        return min(draw, key=draw.get)

    def walk(key, tree):
        weight = lambda level, of: collections.Counter({getattr(s, level): 0 for s in of}) + collections.Counter(getattr(s, level) for s in of)
        for level in ("region", "rack", "shard"):
            chosen = least(key, level, weight(level, tree))
            tree = [s for s in tree if getattr(s, level) == chosen]
        return chosen

    tree = sharding.planned()
    for i, text in zip(docs.doc_id, docs.text):
        raw, r = (text or "").encode(), got.loc[i]
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert (r.shard, r.grown_shard) == (walk(i, tree), walk(i, sharding.grown(tree)))
    for _, mine in got.groupby("shard"):
        assert sorted(mine.slot) == list(range(len(mine)))


# --- 2 media


@pytest.mark.parametrize("kind,shape", [("pgm", (5, 7)), ("ppm", (4, 3, 3)), ("bmp", (3, 5, 3))])
def test_pictures_round_trip(kind, shape):
    p = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    assert (media.decode(media.encode(p, kind)) == p).all()


def test_other_formats():
    assert media.decode(b"P2\n# note\n2 2\n255\n0 1 2 255").tolist() == [[0, 1], [2, 255]]
    assert media.decode(b"P3 1 1 255 9 8 7").tolist() == [[[9, 8, 7]]]
    assert media.decode(b"P1\n2 1\n1 0").tolist() == [[0, 255]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    for broken in (b"", b"GIF89a", b"P9 1 1"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_resize_and_hash():
    p = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.allclose(media.resize(p, 3, 4), p.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.resize(p, 4, 5).mean(), p.mean())
    assert media.dhash(np.tile(np.arange(90, 0, -1, dtype=np.uint8), (9, 1))) == "f" * 16
    tiles = media.cut(p, 4)
    assert (media.joined(tiles, p.shape) == p).all()
    assert [(t["top"], t["left"]) for t in tiles] == [(0, 0), (0, 4), (4, 0), (4, 4)]
    import io

    assert (np.load(io.BytesIO(tiles[3]["npy"])) == p[4:, 4:]).all()


def test_media_query(spark, odd, empty):
    out = media.features(media.pictures(odd)).toPandas()
    texts = {r.doc_id if r.doc_id is not None else -1: r.text for r in odd.collect()}
    for r in out.itertuples():
        raw = (texts[-1 if pd.isna(r.doc_id) else int(r.doc_id)] or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert media.features(media.pictures(empty)).count() == 0
    t = media.tiles(media.pictures(odd), side=16).filter("doc_id = 5").first()
    assert t.height * t.width * t.channels == 576 and t.tiles[0].dhash


def test_media_query_against_bytes_and_areas_by_hand(spark, sf, docs):
    """Stored bytes by the formats' definitions; hash bits by exact area means, but for those within rounding of a tie."""
    import struct

    got = QUERIES["op2_media_columns"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    kinds, clear = set(), 0
    for i, text in zip(docs.doc_id, docs.text):
        raw, r = (text or "").encode(), got.loc[i]
        data = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        kind, n = zlib.crc32(data) % 3, len(data) // 24
        kinds.add(kind)
        rgb = np.frombuffer(data, np.uint8).reshape(n, 8, 3).astype(int)
        if kind == 0:
            stored, light, shape = b"P5\n24 %d\n255\n" % n + data, rgb.reshape(n, 24), f"{n}x24x1"
        else:
            light, shape = (299 * rgb[..., 0] + 587 * rgb[..., 1] + 114 * rgb[..., 2]) // 1000, f"{n}x8x3"
            stored = b"P6\n8 %d\n255\n" % n + data
        if kind == 2:
            rows = rgb[::-1, :, ::-1].astype(np.uint8).tobytes()
            stored = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, 8, n, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        cover = lambda parts, size: np.clip(np.minimum.outer(np.arange(1, parts + 1) * size, parts * np.arange(1, size + 1)) - np.maximum.outer(np.arange(parts) * size, parts * np.arange(size)), 0, None)
        mean = 256 * (cover(8, n) @ light @ cover(9, light.shape[1]).T) / light.size
        drop = (mean[:, :-1] - mean[:, 1:]).ravel()
        found, bits = r.feature.split(":")
        assert found == shape
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8)).astype(bool)
        level = (abs(drop) < 1e-6) & (abs(mean[:, 1:] % 1 - 0.5) > 1e-3).ravel()  # equal neighbours, as in what is filled up
        assert bits[drop > 1 + 1e-6].all() and not bits[(drop < -1e-6) | level].any()
        clear += ((drop > 1 + 1e-6) | (drop < -1e-6) | level).mean()
        if r.tiles == 1:
            assert r.tile_hashes == hashlib.sha256(r.feature.split(":")[1].encode()).hexdigest()
    assert kinds == {0, 1, 2} and clear > 0.9 * len(docs)


# --- 3 decontamination


def plain_contamination(texts, items, window=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if x := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= x
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_contamination(spark, odd, empty, sf, docs):
    items = [(1, "Fox jumps over"), (2, None), (3, ""), (4, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (5, "fox jumps over"), (6, "not in there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(odd, bench).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == plain_contamination([r.text for r in odd.collect()], items)
    span = next(r for r in got if r.doc_id == 1).spans[0]
    assert (span["doc_start"], span["n_words"], span["item_start"]) == (3, 3, 0)
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(odd, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontamination.clean(odd, bench).count() == 9
    # blocks of the benchmark give the same
    small = decontamination.contamination(odd, bench, block_bytes=10).collect()
    assert [(r.n_hit, r["items"]) for r in small] == [(r.n_hit, r["items"]) for r in got]
    full = {r.doc_id: r for r in QUERIES["op3_suffix_search"](spark, sf).collect()}
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    for i, (n, h, found) in zip(docs.doc_id, plain_contamination(docs.text, list(zip(b.item_id, b.text)))):
        r = full[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, h, len(found), decontamination.digest(found))


# --- 4 language model


def test_model_is_a_distribution():
    """The probabilities of the words that can follow add up to one at most; those of the subwords to one."""
    rng = np.random.default_rng(0)
    target = rng.integers(0, 20, 400).astype(np.int32)
    m = lm_scoring.train(target, np.array([0, 150, 400]), 21, epochs=1)
    assert np.allclose(m.t.sum(0), 1, atol=1e-4)
    opens = np.zeros(21, bool)
    opens[[0, 1, 20]] = True
    total = 0.0
    for first in range(21):
        t = np.array([first, 20], np.int32)
        m.opening = (m.t * opens[:, None]).sum(0)
        inputs, known, goal, real = m.shape(t, np.array([0, 2]), *lm_scoring.windows(np.array([0, 2])))
        joint, norm, _ = m.mixture(inputs, known, goal)
        total += (joint.sum(-1) / norm)[real][0]
    assert abs(total - 1) < 1e-3


def test_windows_score_each_token_once():
    rng = np.random.default_rng(0)
    target = np.r_[0, rng.integers(0, 20, 99)].astype(np.int32)
    m = lm_scoring.train(target, np.array([0, 100]), 21, epochs=1)
    opens = np.ones(21, bool)
    assert len(m.score(target, np.array([0, 100]), opens)) == 100
    # what comes later doesn't change what was scored before
    other = target.copy()
    other[60:] = 3
    assert np.allclose(m.score(target, np.array([0, 100]), opens)[:59], m.score(other, np.array([0, 100]), opens)[:59], atol=1e-5)


def test_lm_query(spark, sf, docs):
    got = QUERIES["op4_attention_lm"](spark, sf).toPandas().set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.doc_id}
    tokens = {i: [*SPACE.findall(lower(t)), None] for i, t in zip(docs.doc_id, docs.text)}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    assert (got.score < 0).all()


def test_lm_odd_rows(odd, empty):
    from pyspark.sql import functions as F

    out = lm_scoring.score(odd.select("doc_id", "text", "size"), F.lit(False)).toPandas()
    assert len(out) == 12 and np.isfinite(out.score).all()
    assert set(out[out.doc_id == 3].n_tokens) == {1}
    assert lm_scoring.score(empty, F.lit(False)).count() == 0
    nothing = lm_scoring.score(odd.limit(3), F.lit(True)).toPandas()
    assert (nothing.n_known == 0).all() and (nothing.train_tokens == 0).all()


def test_lm_distributions_rest_on_all_text(spark):
    """Every subword of the training texts has more than the prior, wherever in them it occurs."""
    names = ["red", "blue", "green", "black", "white", "brown", "orange", "yellow", "silver", "gold", "water", "stone"]
    texts = [f"the {w} " * 20 for w in names] + ["the " * 300 + "house " * 20 + "the " * 300 + "river " * 20]
    m = lm_scoring.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), start_docs=1)
    ids, at = lm_scoring.subwords(lm_scoring.VOCABULARY).encode([w.encode() for w in [*names, "house", "river", "purple"]])
    share = m.t[ids].sum(1)
    assert (share[: at[-2]] > 2 * share[at[-2]]).all()
    assert m.words == sum(len(t.split()) + 1 for t in texts)


def test_lm_gradient_is_that_of_the_likelihood():
    """Finite differences of the log-likelihood by some entries of every array."""
    rng = np.random.default_rng(1)
    target = rng.integers(0, 20, 130).astype(np.int32)
    begin = np.array([0, 50, 130])
    m = lm_scoring.train(target, begin, 21, epochs=1)
    for name in ("e", "t", *m.DENSE):
        setattr(m, name, getattr(m, name).astype(np.float64))
    inputs, known, goal, real = m.shape(target, begin, *lm_scoring.windows(begin))
    grad = m.ready().gradient()
    expected = m.descend(inputs, known, goal, real, grad)
    assert np.allclose(expected.sum(1), 1) and grad["n"] == 130

    def loss():
        m.ready().opening = m.t[0]
        joint, total, _ = m.mixture(inputs, known, goal)
        return -np.log(joint.sum(-1) / total)[real].sum()

    for name, g in ({"e": grad["e"]} | m.by_projection(grad)).items():
        values = getattr(m, name).ravel()
        for i in rng.choice(len(values), min(6, len(values)), replace=False):
            old, around = values[i], []
            for sign in (1, -1):
                values[i] = old + sign * 1e-4
                m.distance = lambda: np.where((gap := np.arange(8, 32)[:, None] - np.arange(32)) >= 0, m.bias[np.maximum(gap, 0)], -np.inf)
                around.append(loss())
            values[i] = old
            assert math.isclose((around[0] - around[1]) / 2e-4, g.ravel()[i], rel_tol=1e-3, abs_tol=1e-5), name


def test_lm_learns_from_all_training_text(spark, sf):
    """Every id of the training documents moves from where the start left it, and held-out text gets likelier by it."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(4)
    held = lm_scoring._held_out("doc_id")
    start = lm_scoring.begin_fit(d.filter(~held), start_docs=20)
    m, _, _ = lm_scoring.passed(d, held, start_docs=20)
    sw = lm_scoring.subwords(lm_scoring.VOCABULARY)
    met = {"train": set(), "held": set()}
    texts = {"train": [], "held": []}
    for r in d.withColumn("held", held).collect():
        kind = "held" if r.held else "train"
        w = lm_scoring.Words(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())]))
        texts[kind].append(lm_scoring.spread(*sw.encode(w.spelled()), w.code, w.first, sw.end)[0])
        met[kind] |= set(texts[kind][-1][:-1].tolist())
    moved = (m.e != start.e).any(1)
    ids = np.array(sorted(met["train"]))
    assert moved[ids].all() and moved[sw.end]
    assert not moved[sorted(set(range(sw.end)) - met["train"])].any()
    assert all((getattr(m, n) != getattr(start, n)).any() for n in m.DENSE)
    target, begin = np.concatenate(texts["held"]), np.r_[0, np.cumsum([len(x) for x in texts["held"]])]
    after = m.score(target, begin, sw.opens).sum()
    only = start.copy()
    only.t = m.t  # the distributions of all text on the start's embeddings
    assert after > only.score(target, begin, sw.opens).sum() > start.score(target, begin, sw.opens).sum()


def test_lm_runs_are_scored_without_cutting_texts_again(spark, odd, monkeypatch):
    """The table of the pass is enough for the scores; its runs give back words and subwords, also of no words and of many to a word."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql import functions as F

    sw = lm_scoring.subwords(lm_scoring.VOCABULARY)
    for texts in ([None, "", "  "], ["a " * 300, "b" * 3000 + " a", None], [" ".join(f"w{i}" for i in range(70000))]):
        w = lm_scoring.Words(*textio.flat(pa.array(texts, pa.string())))
        ids, at = sw.encode(w.spelled())
        held = np.array([False] * len(texts))
        code, subs, places, bucket, first, out = lm_scoring._decoded(lm_scoring._coded(w, ids, at, held, 300))
        for got, want in ((code, w.code), (subs, ids), (places, at), (bucket, w.hash % np.uint64(300)), (first, w.first), (out, held)):
            assert np.array_equal(got, want)
    d = odd.select("doc_id", "text").repartition(1)
    m, posted, buckets = lm_scoring.passed(d, F.lit(False))
    rows = posted.filter("kind = 1").select("blob", F.lit(None).cast("long").alias("key"), "a", "b", "size", "ids").toArrow()
    counts = posted.filter("kind = 0").groupBy("key").applyInArrow(lm_scoring._total, lm_scoring._RUN).toArrow()
    monkeypatch.setattr(lm_scoring, "Words", None)
    got = lm_scoring._scored(pa.concat_tables([rows.cast(counts.schema), counts]), lm_scoring.VOCABULARY, buckets, SimpleNamespace(value=m), m.words, m.ends)
    assert got.num_rows == 12 and np.isfinite(got.column("score").to_numpy()).all()


def test_lm_ceilings_are_kept_where_they_can_be_reached():
    """Weights and gates of any size give finite probabilities; where none can reach the ceiling, it isn't applied."""
    target, begin = np.arange(40, dtype=np.int32) % 20, np.array([0, 40])
    m = lm_scoring.train(target, begin, 21, epochs=1)
    assert not m.steep and not m.steep_gate
    m.e, m.g = m.e * 100, m.g * 1000
    assert m.ready().steep and m.steep_gate
    assert np.isfinite(m.score(target, begin, np.ones(21, bool))).all()


def test_lm_long_tokens_have_no_floor(spark):
    """A text without blanks that isn't in training is the less probable the longer it is; the rest are as before."""
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 60000))
    rows = [(0, "some words to learn from"), (1, text[:3000]), (2, text[:6000]), (3, text)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_scoring.score(d, d.doc_id > 0).toPandas().set_index("doc_id").score
    assert np.isfinite(got).all()
    assert got[1] < -1000 and 1.8 < got[2] / got[1] < 2.2 and 18 < got[3] / got[1] < 22
    assert np.allclose(lm_scoring._mixed(np.array([2, 0]), 8, np.array([-2.0, -5000.0])), [math.log10(0.125 + 0.005), -5000 + math.log10(0.5)])


# --- 5 mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, goal, free = share * sum(sizes.values()), {}, set(order)
    while True:
        level = total / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > epochs * sizes[s]}
        if not over:
            return goal | {s: level * w[s] for s in free}
        for s in over:
            goal[s] = epochs * sizes[s]
            total -= goal[s]
        free -= over


def test_mix(spark, odd, empty, sf):
    for d in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        out = mixing.mix(d.select("doc_id", "text", "source", "n_chars"), carry=["source", "text"]).toPandas()
        assert (out["size"] == [len(SPACE.findall((t or "").encode())) for t in out.text]).all()
        out["source"] = out.source.astype(object).where(out.source.notna(), None)
        sizes = {s: int(out[[x == s for x in out.source]]["size"].sum()) for s in set(out.source)}
        goal = plain_targets(sizes)
        for s, total in sizes.items():
            rows = out[[x == s for x in out.source]]
            assert (rows.source_size == total).all() and np.allclose(rows.target, goal[s])
            assert abs(rows.taken.sum() - goal[s]) <= 0.51
        assert (out.taken <= 2 * out["size"]).all()
    assert mixing.mix(empty).count() == 0
    again = mixing.mix(odd).toPandas()
    assert again.equals(mixing.mix(odd).toPandas()) or sorted(map(tuple, again.fillna(-1).values)) == sorted(map(tuple, mixing.mix(odd).toPandas().fillna(-1).values))


# --- 6 quality


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op6_additive_quality"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    test = out[out.held_out]
    assert (test.predicted == test.quality).mean() > 0.97 and out.score.between(0, 1).all()
    f = quality.feature_table(odd)
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(f, quality.fit(f, labels)).count() == 12
    assert {r.score for r in quality.score(f, quality.fit(f, labels.limit(0))).collect()} == {0.5}
    assert quality.score(quality.feature_table(empty), quality.fit(f, labels)).count() == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = quality.train(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85 and (1, 0) in m.pairs


# --- 7 Jaccard join


def plain_sets(texts, width=5):
    out = []
    for t in texts:
        w = SPACE.findall(lower(t))
        out.append(set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def plain_components(ids, found, percent=75):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if found[i] and found[j] and 100 * len(found[i] & found[j]) >= percent * len(found[i] | found[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) if found[i] else ids[i] for i in range(len(ids))]


def test_jaccard_query(spark, sf, docs):
    got = QUERIES["op7_jaccard_join"](spark, sf).toPandas().set_index("doc_id")
    found = plain_sets(docs.text)
    for i, s, c in zip(docs.doc_id, found, plain_components(list(docs.doc_id), found)):
        assert (got.loc[i].n_shingles, got.loc[i].component_id) == (len(s), c)


def test_jaccard_family_of_near_copies(spark):
    """Near copies at about the threshold: all links count, whichever step finds them."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for k in rng.choice(120, rng.integers(0, 7), replace=False):
            t[k] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base[:60]) + " " + " ".join(f"y{i}_{k}" for k in range(60))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingle_join.groups(d).collect()}
    want = plain_components([r[0] for r in rows], plain_sets([r[1] for r in rows]))
    assert [got[r[0]] for r in rows] == want


def test_jaccard_odd_rows(odd, empty):
    rows = odd.collect()
    found = plain_sets([r.text for r in rows])
    want = sorted((r.doc_id or -1, len(s), c or -1) for r, s, c in zip(rows, found, plain_components([r.doc_id for r in rows], found)))
    got = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_shingles, -1 if pd.isna(r.component_id) else int(r.component_id)) for r in shingle_join.groups(odd).toPandas().itertuples())
    assert got == want
    assert shingle_join.groups(empty).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(50, 60), (60, 55), (70, 70), (None, 3)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 50: 50, 60: 50, 55: 50}


def test_components_that_are_stars_take_no_round_and_grow_by_the_new_links_alone(spark):
    star = spark.createDataFrame([(5, 1), (1, 7), (9, 4), (4, 4), (None, 2)], "a long, b long")
    assert {r.vertex: r.component for r in components.components(star, rounds=0).collect()} == {1: 1, 5: 1, 7: 1, 4: 4, 9: 4}
    rng = np.random.default_rng(8)
    old, new = (rng.integers(0, 300, (n, 2)).tolist() for n in (150, 60))
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    every = spark.range(300).toDF("v")
    label = lambda links: every.join(components.components(table(links)).withColumnRenamed("vertex", "v"), "v", "left").selectExpr("v", "coalesce(component, v) c")
    want = {r.v: r.c for r in label(old + new).collect()}
    assert {r.v: r.c for r in components.grown(label(old), "v", "c", table(new)).collect()} == want
    assert {r.v: r.c for r in components.grown(label(old), "v", "c", table(old[:20])).collect()} == {r.v: r.c for r in label(old).collect()}



# --- 8 suffix arrays


def test_grouping_sorts_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(300):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 50)).tolist()
        t = t * int(rng.integers(1, 4)) + [0]
        assert suffix_dedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def plain_repeats(raws, width):
    seen = collections.Counter(r[p : p + width] for r in raws for p in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - width + 1):
            if seen[r[p : p + width]] > 1:
                gone[p : p + width] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def test_suffix_query(spark, sf, docs):
    got = QUERIES["op8_suffix_dedup"](spark, sf).toPandas().set_index("doc_id")
    for i, want in zip(docs.doc_id, plain_repeats([(t or "").encode() for t in docs.text], 400)):
        r = got.loc[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want


def test_suffix_passages_of_exact_length(spark):
    """Repeats of 399, 400 and 401 bytes at all alignments, overlapping ones, and ones inside a document."""
    rng = np.random.default_rng(4)
    word = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    a, b, c = word(399), word(400), word(401)
    rows = [word(37) + a + word(50), word(91) + a + word(3), b + word(11), word(200) + b, word(5) + c + word(64) + c + word(1), "z" * 900, word(900), word(100) + b[50:] + c[:350] + word(20)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), suffix_dedup.digest(bytes(r.kept))) for r in suffix_dedup.dedup(d).collect())
    assert got == [(i, *w) for i, w in enumerate(plain_repeats([r.encode() for r in rows], 400))]


def test_suffix_odd_rows(odd, empty):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), suffix_dedup.digest(bytes(r.kept))) for r in suffix_dedup.dedup(odd).collect())
    rows = odd.collect()
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, *w) for r, w in zip(rows, plain_repeats([(r.text or "").encode() for r in rows], 400)))
    assert suffix_dedup.dedup(empty).count() == 0


# --- 9 lines


def plain_lines(rows, percent=75):
    lines = [(i, n, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))) for n, (i, t) in enumerate(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    order = sorted(range(len(lines)), key=lambda q: (lines[q][0] is not None, lines[q][0] or 0, lines[q][1], lines[q][2]))
    gone = collections.defaultdict(list)
    for p, q in enumerate(order):
        s = lines[q][3]
        if s and any((o := lines[r][3]) and 100 * len(s & o) >= percent * len(s | o) for r in order[:p]):
            gone[lines[q][1]].append(lines[q][2])
    return [sorted(gone[n]) for n in range(len(rows))]


def test_lines(spark, odd, empty, sf, docs):
    rows = [(r.doc_id, r.text) for r in odd.coalesce(1).collect()]
    want = plain_lines(rows)
    got = line_dedup.dedup(odd.coalesce(1)).collect()
    key = lambda i, n, x: (-1 if i is None else i, n, tuple(x))
    assert sorted(key(r.doc_id, r.n_lines, r.removed) for r in got) == sorted(key(i, 0 if t is None else t.count("\n") + 1, w) for (i, t), w in zip(rows, want))
    assert line_dedup.dedup(empty).count() == 0
    full = {r.doc_id: r.removed for r in QUERIES["op9_line_dedup"](spark, sf).collect()}
    for i, w in zip(docs.doc_id, plain_lines(list(zip(docs.doc_id, docs.text)))):
        assert full[i] == ",".join(map(str, w))


# --- 10 language


def test_language(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{sf}/documents.parquet")
    out = QUERIES["op10_language_id"](spark, sf).toPandas().merge(d, on="doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    test = out[out.held_out]
    assert (test.lang_pred == test.lang).mean() > 0.98 and out.score.between(0, 1).all() and out.rejected.mean() < 0.01
    model = language.fit(odd)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in language.predict(odd, model, keep=["doc_id"]).collect()}
    assert {(3, "und", True), (4, "und", True), (6, "und", True), (8, "und", True)} <= got and {p for _, p, _ in got} <= {"und", "en", "de"}
    assert language.predict(empty, model, keep=["doc_id"]).count() == 0
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.predict(odd, None, keep=["doc_id"]).collect()} == {"und"}


def test_contamination_in_many_passes(spark, odd):
    """More blocks than one pass holds give the same rows, in any order."""
    items = [(1, "Fox jumps over"), (2, None), (4, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem"), (5, "fox jumps over"), (6, "not in there at all"), (7, "lazy dog")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], sorted((s["item"], s["item_start"], s["doc_start"], s["n_words"]) for s in r.spans)) for r in df.collect())
    assert rows(decontamination.contamination(odd, bench, block_bytes=10, held=2)) == rows(decontamination.contamination(odd, bench))


def test_longest_matches(spark, sf, docs, odd, empty):
    """Each test suffix's longest match over all documents, against a search of every document."""
    from pyspark.sql import functions as F

    bench = spark.createDataFrame([(1, "zzz fox jumps over the lazy cat"), (2, None), (3, "word Lorem ipsum dolor"), (4, "fox jumps over the lazy cat")], "item_id long, text string")
    texts = [(r.doc_id, ALNUM.findall(lower(r.text))) for r in odd.collect()]
    want = {}
    for item, text in bench.collect():
        w = ALNUM.findall(lower(text))
        for k in range(len(w)):
            best = None
            for i, t in texts:
                for p in range(len(t)):
                    n = 0
                    while k + n < len(w) and p + n < len(t) and w[k + n] == t[p + n]:
                        n += 1
                    if n and (best is None or (-n, i is None, i, p) < best):
                        best = (-n, i is None, i, p)
            if best:
                want[str(item), k] = (-best[0], best[2], best[3])
    got = decontamination.longest_matches(odd, bench, block_bytes=20).collect()
    assert {(r["item"], r.item_start): (r.n_words, r.doc_id, r.doc_start) for r in got} == want and len(got) == len(want)
    assert decontamination.longest_matches(empty, bench).count() == 0 and decontamination.longest_matches(odd, bench.limit(0)).count() == 0
    # on whole tables: what is contaminated has a match of a window's length, and such a match is in a contaminated document
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = decontamination.contamination(d, b).filter("n_hit > 0")
    long = decontamination.longest_matches(d, b).filter("n_words >= 10")
    assert long.join(hit, "doc_id", "left_anti").isEmpty() and hit.isEmpty() == long.isEmpty()
    spans = hit.select("doc_id", F.explode("spans").alias("s")).agg(F.max("s.n_words")).first()[0]
    assert spans == long.agg(F.max("n_words")).first()[0]


def plain_shared(texts, size):
    """Whether each text has a string of `size` words that a text elsewhere has as well."""
    words_ = [SPACE.findall((t or "").encode()) for t in texts]
    where = collections.defaultdict(set)
    for k, w in enumerate(words_):
        for p in range(len(w) - size + 1):
            where[tuple(w[p : p + size])].add(k)
    several = {s for s, who in where.items() if len(who) > 1}
    return [any(tuple(w[p : p + size]) in several for p in range(len(w) - size + 1)) for w in words_]


@pytest.mark.parametrize("size", [5, 12, 51])
def test_shared_passages(spark, odd, empty, docs, size):
    """Against all strings of all documents; short ones, edges of texts, strings within one text alone, copies."""
    rng = np.random.default_rng(size)
    say = lambda n: " ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    p, q = say(size), say(size - 1)
    rows = [(1, f"{say(30)} {p} {say(40)}"), (2, f"{p}\t{say(9)}"), (3, f"{say(9)}\n{p}"), (4, f"{say(20)} {q} {say(20)}"), (5, f"{q} {say(30)}"), (6, f"{(r := say(size))} . {r}"), (7, say(200)), (8, say(200)), (9, None), (10, ""), (11, p)]
    rows += [(20, s := say(size + 3)), (21, s)]
    for d, key in ((spark.createDataFrame(rows, "doc_id long, text string"), None), (spark.createDataFrame(docs[["doc_id", "text"]]), None), (odd, None)):
        t = d.select("doc_id", "text").toPandas()
        t["doc_id"] = [-1 if pd.isna(i) else int(i) for i in t.doc_id]
        got = collections.Counter((-1 if r.doc_id is None else r.doc_id, r.shares) for r in suffix_dedup.sharing(d, size=size).collect())
        assert got == collections.Counter(zip(t.doc_id, plain_shared([x if isinstance(x, str) else "" for x in t.text], size)))
    assert suffix_dedup.shared_passages(empty, size=size).count() == 0


def test_shared_passages_of_common_anchors(spark, docs, monkeypatch):
    """Anchors that many texts have, taken string by string, give the same texts."""
    d = spark.createDataFrame(docs[["doc_id", "text"]])
    found = lambda: sorted(bytes(r.digest) for r in suffix_dedup.shared_passages(d, size=12).collect())
    once = found()
    monkeypatch.setattr(suffix_dedup, "OFTEN", 1)
    assert found() == once and once
