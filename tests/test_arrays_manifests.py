"""Flat arrays by byte ranges, and manifests that read only what changed."""

import hashlib
import os
import struct

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import arrays, manifests
from corpusmill.sources.places import listed


def test_a_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(struct.pack("<1000i", *range(0, 2000, 2)) + b"\1\2")
    read = arrays.read_array(spark, str(tmp_path / "x.bin"), "i", split_bytes=402)
    assert read.rdd.getNumPartitions() == 10
    assert [(r.pos, r.value) for r in read.orderBy("pos").collect()] == [(i, 2 * i) for i in range(1000)]


@pytest.mark.parametrize(("code", "values"), [("i", [-5, 0, 7]), ("q", [1 << 40, -1, 3]), ("f", [0.5, -2.0, 8.25]), ("d", [1e300, -0.125, 3.0])])
def test_written_arrays_come_back(spark, tmp_path, code, values):
    rows = spark.createDataFrame([(float(v) if code in "fd" else v,) for v in values], f"value {'double' if code in 'fd' else 'long'}").coalesce(1)
    for _ in range(2):
        arrays.write_array(rows, str(tmp_path / "out"), code)
    got = arrays.read_array(spark, str(tmp_path / "out"), code).orderBy("file", "pos").collect()
    assert [r.value for r in got] == values * 2 and [r.pos for r in got] == [0, 1, 2] * 2
    assert len(listed(str(tmp_path / "out"))) == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="no place for nulls"):
        arrays.write_array(spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).alias("value")).repartition(3), path, "q")
    assert listed(path) == [] and not [n for n in os.listdir(path) if n.startswith("_")]


def test_no_elements_and_no_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\1\2\3")
    assert arrays.read_array(spark, str(tmp_path), "q").count() == 0
    with pytest.raises(Exception, match="(?i)missing"):
        arrays.read_array(spark, str(tmp_path / "missing"), "q").count()


def test_only_changed_files_are_measured(spark, tmp_path):
    root = tmp_path / "root"
    (root / "in").mkdir(parents=True)
    texts = {"a.jsonl": '{"a": 1}\n\n{"b": 2, "a": 3}', "in/b.json": '{"c": 1}\n[1]\n', "bad.jsonl": '{"a": 1}\nnope\n', "raw.bin": "12345", "old.jsonl": '{"o": 1}', "empty.jsonl": ""}
    for name, text in texts.items():
        (root / name).write_text(text)
    name = F.substring_index("file", "/root/", -1)

    def seen(rows):
        return {r.name: r for r in rows.withColumn("name", name).collect()}

    manifests.current_manifest(spark, str(root)).write.parquet(str(tmp_path / "kept"))
    before = spark.read.parquet(str(tmp_path / "kept"))
    got = seen(before)
    assert {k: (r.records, r.fields) for k, r in got.items()} == {"a.jsonl": (2, ["a", "b"]), "in/b.json": (1, ["c"]), "bad.jsonl": (None, []), "raw.bin": (None, []), "old.jsonl": (1, ["o"])}
    assert all(r.fresh and r.sha256 == hashlib.sha256(texts[k].encode()).hexdigest() for k, r in got.items())
    assert not [r for r in manifests.current_manifest(spark, str(root), before).collect() if r.fresh]
    (root / "a.jsonl").write_text('{"z": 1}\n')
    (root / "old.jsonl").unlink()
    (root / "new.jsonl").write_text('{"n": 1}')
    again = seen(manifests.current_manifest(spark, str(root), before))
    assert {k for k, r in again.items() if r.fresh} == {"a.jsonl", "new.jsonl"} and "old.jsonl" not in again
    assert again["a.jsonl"].fields == ["z"] and again["bad.jsonl"].sha256 == got["bad.jsonl"].sha256


def test_a_line_longer_than_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifests, "BLOCK", 7)
    (tmp_path / "x.jsonl").write_text('{"long name": "' + "é" * 50 + '"}\n{"k": 1}\n')
    assert manifests._measured(str(tmp_path / "x.jsonl"))[1:] == (2, ["k", "long name"])
