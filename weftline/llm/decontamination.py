"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are short, documents long, so the Jaccard similarity of the two says little; containment of the item does. Items
are partitioned into bands by their number of shingles. Each item is represented by its b smallest shingle hashes (a
bottom-b MinHash sketch), b = n - ceil(t * n) + 1 for the band's largest n: a document that holds a share t of the item
misses at most n - ceil(t * n) of its shingles, hence holds one of the b. So the sketch search loses nothing, for any
length of document, and exact containment then decides.

Documents are scanned once; a window is hashed only where all its words occur in the items. The sketches of a block of
items (bounded by `block_shingles`, which is checked by counting; a longer single item is a block of its own) are
broadcast; more items are searched in further blocks, each a pass over the texts. Nothing is shuffled or written, so hot
sources, copies and common passages cost only their own rows.

Defined results: items and documents are compared on words `[^\\x20\\x09-\\x0D]+` in lower case; an item of fewer than
five words is one shingle of all its words; items and documents without words match nothing; equal items match alike,
each by its id, in the items' order of ids; repeated documents give repeated rows; very long texts are searched whole;
empty tables give no matches; clean returns all columns of docs, whatever their names, the others read only id and text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 5
THRESHOLD = 0.8
#: Shingles of the items in one broadcast block, at most (about 200 bytes each on an executor).
BLOCK_SHINGLES = 300_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(ws: list[str]) -> set[tuple[str, ...]]:
    """Distinct shingles of WIDTH words; of a shorter text, all its words as one."""
    k = min(WIDTH, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if k else set()


def band_top(n: int) -> int:
    """The largest size in n's band; bands end at powers of 1.25, rounded up."""
    top = 1
    while top < n:
        top = max(top + 1, math.ceil(top * 1.25))
    return top


def sketch_size(n: int, threshold: float) -> int:
    top = band_top(n)
    return min(n, top - math.ceil(threshold * top - 1e-9) + 1)


class Sketches:
    """The sketches of one block of items, and the shingles to verify with."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, set[tuple[str, ...]]]] = []
        hashed: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            if not (own := shingles(ws := words(text))):
                continue
            for w in ws:
                self.ids.setdefault(w, len(self.ids) + 1)
            width = min(WIDTH, len(ws))
            codes = np.array([[self.ids[w] for w in s] for s in own], np.uint64)
            # ids are in order of appearance, so the mixed value stands for a random order
            for h in np.sort(self.hashes(codes))[: sketch_size(len(own), threshold)]:
                hashed[width][int(h)].append(len(self.items))
            self.items.append((item_id, own))
        self.tables = {w: (np.array(sorted(t), np.uint64), dict(t)) for w, t in hashed.items()}

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each row of word ids."""
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = (h ^ codes[:, j]) * _MIX[j]
            h ^= h >> np.uint64(29)
        return h

    def find(self, text: str | None) -> list[dict]:
        ws = words(text)
        known = np.fromiter(map(self.ids.get, ws, [0] * len(ws)), np.uint64, len(ws))
        runs = np.concatenate(([0], np.cumsum(known > 0)))
        found: set[int] = set()
        for width, (sorted_, of) in self.tables.items():
            if len(ws) < width:
                continue
            starts = np.flatnonzero(runs[width:] - runs[:-width] == width)
            if len(starts):
                codes = known[starts[:, None] + np.arange(width)]
                h = self.hashes(codes)
                at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
                for x in np.unique(h[sorted_[at] == h]):
                    found.update(of[int(x)])
        if not found:
            return []
        out, own = [], {}
        for i in sorted(found):
            item_id, wanted = self.items[i]
            k = len(next(iter(wanted)))
            if k not in own:
                own[k] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
            shared = len(wanted & own[k])
            if shared >= self.threshold * len(wanted) - 1e-9:
                out.append({"item_id": item_id, "n_shingles": len(wanted), "n_shared": shared, "containment": shared / len(wanted)})
        return out


_HITS = "array<struct<item_id: bigint, n_shingles: bigint, n_shared: bigint, containment: double>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())]))


def _search(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    """Rows (key, text) to key and hits, where there are any."""
    shared = docs.sparkSession.sparkContext.broadcast((items, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Sketches(*shared.value)
        for b in batches:
            hits = [index.find(t) for t in b.column(1).to_pylist()]
            at = pa.array([i for i, h in enumerate(hits) if h], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([h for h in hits if h], _HIT)], ["key", "hits"])

    return docs.mapInArrow(run, f"key {dict(docs.dtypes)['key']}, hits {_HITS}")


def _blocks(items: DataFrame, item_id: str = "item_id", item_text: str = "text", block_shingles: int = BLOCK_SHINGLES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_shingles words; one block at a time is on the driver."""
    n_words = F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), r"[\x20\x09-\x0D]+"))
    table = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.sum(n_words)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_shingles))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    for b in range(blocks):
        yield sorted(((r["i"], r["t"]) for r in table.where(block == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """key, hits: of each row of docs and block of items with a match, the key column and the items that the text contains."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return reduce(DataFrame.unionByName, (_search(slim, rows, threshold) for rows in _blocks(items, item_id, item_text, block_shingles)))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: a row for each document and item that it contains."""
    found = search(docs, items, doc_id, text, **options)
    return found.select(F.col("key").alias("doc_id"), F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those that contain an item; all their columns.

    One block of items: rows travel packed through its pass. More: the texts with a match are found by each block, and rows
    with such texts leave by the texts' 128-bit hashes; only those hashes are shuffled, no text is written.
    """
    blocks = list(islice(_blocks(items, **{k: v for k, v in options.items() if k != "threshold"}), 2))
    threshold = options.get("threshold", THRESHOLD)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    if len(blocks) == 1:
        kept = _without(packed, blocks[0], threshold)
    else:
        key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
        keyed = packed.withColumn("_key", key)
        found = search(keyed, items, "_key", "text", **options).select(F.col("key").alias("_found")).distinct()
        kept = keyed.join(found, F.col("_key") == F.col("_found"), "left_anti")
    return kept.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def _without(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Sketches(*shared.value)
        for b in batches:
            at = [i for i, t in enumerate(b.column(1).to_pylist()) if not index.find(t)]
            yield b.take(pa.array(at, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
