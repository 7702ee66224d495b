"""The data source of fields: ranges of any size give the fields of the whole, and the readers read through it."""

import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshgrain.sources import fields, files


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1 \n\t\r", max_size=40), st.integers(1, 12), st.integers(1, 7))
def test_ranges_give_each_field_once(text, block, chunk):
    data = text.encode()
    found = [x for s in range(0, len(data), block) for part in fields.chunks(io.BytesIO(data), s, min(s + block, len(data)), chunk) for x in part]
    assert found == data.split()


def test_long_fields_and_ends():
    data = b"a" * 50 + b" b\r\n" + b"c" * 9
    for block in (1, 3, 10, 52, 100):
        starts = {s: [x for p in fields.chunks(io.BytesIO(data), s, min(s + block, len(data)), 4) for x in p] for s in range(0, len(data), block)}
        assert sum(starts.values(), []) == data.split()
        assert all(data[s : s + block].strip() or not x for s, x in starts.items())


def test_source(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part-1").write_text("1.5\n2 3\n")
    (tmp_path / "v" / "part-2").write_text("\n")
    (tmp_path / "v" / "part-3").write_text("4e2")
    (tmp_path / "v" / "_SUCCESS").write_text("9")
    for path in (str(tmp_path / "v"), f"file://{tmp_path}/v"):
        for block in (2, 1000):
            rows = fields.numbers(spark, path, block).sort("pos").collect()
            assert [(r.pos, r.x) for r in rows] == [(0, "1.5"), (1, "2"), (2, "3"), (3, "4e2")]
    fields.register(spark)
    counted = spark.read.format("fields").option("counts", "true").load(str(tmp_path / "v"))
    assert counted.columns == ["file", "start", "n"] and sorted(r.n for r in counted.collect()) == [0, 1, 3]
    assert spark.read.format("fields").option("blockbytes", "2").load(str(tmp_path / "v")).rdd.getNumPartitions() == 7
    with pytest.raises(Exception, match="none"):
        fields.numbers(spark, str(tmp_path / "none")).count()


def test_no_fields(spark, tmp_path):
    (tmp_path / "e").write_text("")
    (tmp_path / "f").mkdir()
    assert fields.numbers(spark, str(tmp_path / "e")).count() == 0 and fields.numbers(spark, str(tmp_path / "f")).count() == 0


def test_readers_agree_with_text(spark, tmp_path, monkeypatch):
    """A graph by both ways of reading: through the source and by Spark's lines."""
    (tmp_path / "g.txt").write_text("4 3\n0 1 3 5 6\n0\n0 1\n1 2\n2\n1 1 1 1 1 1\n")
    ways = []
    for through in (True, False):
        monkeypatch.setattr(fields, "readable", lambda path, through=through: through)
        ways.append(sorted(map(tuple, files.read_graph(spark, str(tmp_path / "g.txt")).collect())))
    assert ways[0] == ways[1] == [(0, 0, 0), (1, 0, 1), (1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 2, 1)]


def test_readable():
    assert fields.readable("/a/b.txt") and fields.readable("hdfs://h/a") and not fields.readable("abfs://h/a") and not fields.readable("/a/*.txt") and not fields.readable("/a.gz")
