"""JSONL corpora: reading with provenance, checksums and manifests, lookups, and export."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "array<struct<role: string, content: string>>"
RECORD = f"id string, messages {MESSAGES}, _corrupt string"


def read(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of JSON lines; a line that isn't an object of the schema is kept in _corrupt."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document in each file that the path or glob names."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def located(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), byte_offset, raw_sha256, raw of every line that isn't blank; blank ones still count.

    Exact offsets need a file's bytes in order: one file is one row of binaryFile, cut on its executor. Files beyond
    2 GB have to be split by whoever writes them; `hashed` reads such files without offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                at = 0
                for number, line in enumerate(content.splitlines(keepends=True) if b"\r" not in content else _lines(content), 1):
                    if line.strip():
                        out.append((file, number, at, hashlib.sha256(line).hexdigest(), line.decode("utf-8", "replace").rstrip("\r\n")))
                    at += len(line)
                    if len(out) == 4096:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, line bigint, byte_offset bigint, raw_sha256 string, raw string")


def _lines(content: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(content):
        end = content.find(b"\n", at) + 1 or len(content)
        yield content[at:end]
        at = end


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["file", "line", "byte_offset", "raw_sha256", "raw"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """file, raw, raw_sha256 of every line that isn't blank, split freely; the digest is of the line with its newline."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    return lines.where(F.trim("raw") != "").withColumn("raw_sha256", F.sha2(F.concat("raw", F.lit("\n")), 256))


def lookup(scan: DataFrame, anchors: DataFrame, *keys: str) -> DataFrame:
    """Rows of the scan that the anchors name, with the anchors' columns; an anchor without a row is an error when read."""
    named = anchors.withColumn("_anchor", F.lit(True))
    found = named.join(scan.withColumn("_found", F.lit(True)), list(keys), "left")
    return found.withColumn("_ok", F.assert_true(F.coalesce("_found", F.lit(False)), "an anchor has no record").isNull()).where("_ok").drop("_ok", "_found", "_anchor")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of whole files, those in folders below too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def gated(scan: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """scan, if the files found (path, sha256) have the expected checksums; else reading it is an error.

    found and expected are tables of files, not of rows: what differs is counted before the scan is read.
    """
    want = expected.select("path", F.col("sha256").alias("_want"))
    differ = found.join(want, "path", "full").where(~F.col("sha256").eqNullSafe(F.col("_want")))
    if not differ.isEmpty():
        raise ValueError("a registered source has changed")
    return scan


def relative(path: Column, root: str) -> Column:
    """The part of a file's URI below the folder root."""
    name = root.split(":", 1)[-1].rstrip("/").rsplit("/", 1)[-1]
    return F.regexp_extract(path, rf"/{re.escape(name)}/(.*)$", 1)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """file (relative to root), sha256 of all files below root but hidden ones and unfinished ones."""
    found = checksums(spark, root).select(relative(F.col("path"), root).alias("file"), "sha256")
    return found.where(~F.col("file").rlike(r"(^|/)[._]|\.partial$|(^|/)manifest\.json$"))


def manifest_errors(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """file, reason of a manifest (file, sha256): paths that leave the root, missing files, other contents."""
    found = manifest(spark, root).withColumnRenamed("sha256", "actual")
    unsafe = F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)")
    joined = listed.join(found, "file", "left")
    reason = F.when(unsafe, "unsafe_path").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "changed")
    return joined.select("file", reason.alias("reason")).where("reason IS NOT NULL")


def write_lines(df: DataFrame, path: str) -> None:
    """Canonical JSON lines, columns in name order, nulls kept; an existing path is refused."""
    df.select(sorted(df.columns)).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", order: str = "id") -> None:
    """A folder for each split, each file sorted by id; an existing path is refused."""
    parts = df.repartitionByRange(split, order).sortWithinPartitions(split, order)
    parts.write.mode("errorifexists").partitionBy(split).json(path)
