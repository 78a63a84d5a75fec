"""JSONL scans, manifests, lookups, exports, streams."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.sources import jsonl
from weftline.streaming import dedup

LINES = [b'{"id": "a", "messages": [{"role": "user", "content": "hi"}]}\n', b"\n", b"not json\n", '{"id": "é", "messages": []}'.encode()]


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b"".join(LINES))
    return str(tmp_path / "x.jsonl")


def test_located_scan(spark, corpus):
    got = sorted(jsonl.located(spark, corpus).collect(), key=lambda r: r.line)
    assert [(r.line, r.byte_offset) for r in got] == [(1, 0), (3, len(LINES[0]) + 1), (4, len(LINES[0]) + 1 + len(LINES[2]))]
    assert [r.raw_sha256 for r in got] == [hashlib.sha256(x).hexdigest() for x in LINES if x.strip()]


def test_corrupt_lines_are_kept_apart(spark, corpus):
    rows = jsonl.read(spark, corpus).cache()
    assert rows.where("_corrupt IS NOT NULL").count() == 1 and rows.where("id IS NOT NULL").count() == 2
    assert jsonl.hashed(spark, corpus).count() == 3


def test_anchors_must_be_found(spark, corpus):
    scan = jsonl.located(spark, corpus)
    good = spark.createDataFrame([(1,)], "line long")
    assert jsonl.lookup(scan, good, "line").first().raw_sha256 == hashlib.sha256(LINES[0]).hexdigest()
    with pytest.raises(PySparkException):
        jsonl.lookup(scan, spark.createDataFrame([(77,)], "line long"), "line").collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a")
    (tmp_path / "b.txt").write_bytes(b"b")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"other")
    (tmp_path / "sub" / "x.partial").write_bytes(b"")
    rows = [("a.txt", hashlib.sha256(b"a").hexdigest()), ("sub/a.txt", hashlib.sha256(b"other").hexdigest()), ("b.txt", "0"), ("c.txt", "0"), ("../a.txt", "0")]
    assert {r.file for r in jsonl.manifest(spark, str(tmp_path)).collect()} == {"a.txt", "b.txt", "sub/a.txt"}
    got = {r.file: r.reason for r in jsonl.manifest_errors(spark, str(tmp_path), spark.createDataFrame(rows, "file string, sha256 string")).collect()}
    assert got == {"b.txt": "changed", "c.txt": "missing", "../a.txt": "unsafe_path"}


def test_exports_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("b", "train", None), ("a", "test", 1)], "id string, split string, n int")
    jsonl.write_lines(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text.splitlines()[0]).keys() == {"id", "n", "split"}
    with pytest.raises(PySparkException):
        jsonl.write_lines(df, str(tmp_path / "out"))
    jsonl.write_splits(df, str(tmp_path / "splits"))
    assert {p.name for p in (tmp_path / "splits").glob("split=*")} == {"split=test", "split=train"}


def test_stream_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": str(i), "ts": "2026-01-01T00:00:00Z", "messages": [{"role": "user", "content": c}]} for i, c in enumerate(("Hi", "hi ", "yo", " "))]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = dedup.deduplicated(dedup.valid(dedup.read_stream(spark, str(tmp_path / "in"))))
    q = stream.select("id", F.size("messages").alias("n")).writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("kept").count() == 2
