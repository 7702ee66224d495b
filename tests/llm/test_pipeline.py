"""The pipeline against plain versions of its stages, each on its own input."""

import collections

import corpus_pipeline as cp
from meshgrain.llm import sharding
from meshgrain.llm.shared import written
from test_operators import plain_components, plain_contamination, plain_sets, plain_targets


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, sf):
    import pandas as pd

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in cp.STAGES:
        steps.append(written(stage(spark, steps[-1], sf), name))
    assert [s.columns for s in steps[:-1]] == [columns] * 5
    first, second, third, fourth, last = (s.toPandas() for s in steps[1:])
    # language: only texts without letters or a likely language go
    gone = set(docs.toPandas().doc_id) - set(first.doc_id)
    assert len(gone) < 0.02 * docs.count()
    # near copies: the least id of each component
    comps = plain_components(list(first.doc_id), plain_sets(first.text))
    assert sorted(second.doc_id) == sorted(i for i, c in zip(first.doc_id, comps) if i == c)
    # benchmark
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    hits = plain_contamination(second.text, list(zip(b.item_id, b.text)))
    assert sorted(third.doc_id) == sorted(i for i, (_, h, _) in zip(second.doc_id, hits) if not h)
    # mix: near the targets, within half a document
    size = dict(zip(third.doc_id, third.text.map(lambda t: len((t or "").split()))))
    sizes = collections.Counter()
    for i, s in zip(third.doc_id, third.source):
        sizes[s] += size[i]
    goal = plain_targets(dict(sizes))
    taken = collections.Counter()
    for i, s in zip(fourth.doc_id, fourth.source):
        taken[s] += size[i]
    longest = third.assign(size=third.doc_id.map(size)).groupby("source")["size"].max()
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in sizes)
    assert collections.Counter(fourth.doc_id).most_common(1)[0][1] <= 2
    # shards
    tree = sharding.planned()
    want = {r.doc_id: r.shard for r in sharding.assign(docs.select("doc_id"), "doc_id", tree).collect()}
    assert len(last) == len(fourth) and all(want[i] == s for i, s in zip(last.doc_id, last["shard"]))


def test_stages_on_odd_rows(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = written(stage(spark, docs, sf), name)
        assert 0 < out.count() <= 2 * docs.count()
        assert written(stage(spark, docs.limit(0), sf), name).count() == 0
        docs = out if k < 4 else docs


def test_equal_ids_and_rows(spark, sf):
    text = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "another text of this id with enough words", "en", "a", 1), (2, text + " x", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = rows(cp.distinct(spark, d, sf))
    assert sorted(r[1] for r in out) == sorted([text, "another text of this id with enough words"])


def test_columns_of_any_names(spark, odd, sf):
    """Every stage keeps the columns and values of documents whose names it uses itself, and null ids come last."""
    from pyspark.sql import functions as F

    names = ["n_hit", "n_words", "items", "spans", "score", "rejected", "lang_pred", "region", "rack", "shard", "row_key", "slot", "size", "whole", "part", "taken", "k", "c0", "component_id", "n_shingles"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, sf), name)
        assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + (3 if name == "sharding" else 0)
        assert out.count() and out.filter(" or ".join(f"not {n} <=> '{n} of ' || doc_id" for n in names)).isEmpty()
    last = written(cp.shard(spark, docs, sf), "shards")
    assert last.columns[-3:] == ["_region", "_rack", "_shard"] and last.filter("_shard is null").isEmpty()


def test_null_ids_come_last(spark, sf):
    text = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(None, text, "en", "a", 1), (20, text, "en", "a", 1), (15, text + " x", "en", "a", 1), (-3, "y " + text, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r[0] for r in rows(cp.distinct(spark, d, sf))] == [-3]
    assert [r[0] for r in rows(cp.distinct(spark, d.filter("doc_id is null or doc_id > 0"), sf))] == [15]
