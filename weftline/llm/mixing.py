"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: each source asks for its weight's share of the wanted tokens; no target exceeds `max_repeats` times the
   source's size; what is cut off is shared again by weight (water-filling, computed exactly in rationals).
2. Schedule: slot k gets the point frac(k * golden ratio); the cumulative target shares map the point to a source; slots
   are ranked per source.
3. Blocks: each source's documents, shuffled by a seeded hash, form one token stream that is cut into blocks of equal
   size. The r-th slot of a source reads block r modulo its number of blocks, so a second pass starts only when the
   first is complete. A slot beyond the source's last allowed pass, or past its target, reads nothing or a part.

Running sums (tokens in a source, slots of a source) are two-level: sums within buckets of bounded size, then sums over
bucket totals, so that no source, however hot, is ordered in one task. Only totals per source come to the driver: their
number is that of the registered sources, not of rows, and more than MAX_SOURCES of them are an error.

Defined results: null text has no tokens; documents without tokens are never taken (taken 0); null is a source of its
own, last in order; repeated rows are documents of their own; ties of the shuffle are ordered by id and size; very long
texts are counted whole and span many blocks; an empty table gives an empty schedule; of docs only id, text and source are
read, whatever other columns are called.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.staging import staged

#: Documents in a bucket of the running sum, about.
BUCKET_ROWS = 20_000
#: Slots in a chunk of the running count.
CHUNK_SLOTS = 1 << 14
#: Tokens in a block, unless given.
BLOCK_TOKENS = 2048
#: Sources that a mix may have: a table of them is broadcast, and each slot looks its source up in a list.
MAX_SOURCES = 10_000
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def water_fill(sizes: list[int], weights: list[Fraction], total: Fraction, cap: Fraction) -> list[Fraction]:
    """Shares of total by weight, none above cap * size; the excess goes to the others by weight."""
    out, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), total
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > cap * sizes[i] * whole}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def sized(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    """doc_id, source, size and the shuffle key of each document; the texts are read only here."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"),
    )


def targets(sizes: DataFrame, share: Fraction, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """source, source_size, target, wanted (the target in whole words) and cumulative bounds [low, high) of the schedule's points; one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("n"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: is the source column a registry's?")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))  # str order is by code point
    ns = [int(r["n"]) for r in rows]
    ws = [Fraction(weights[i % len(weights)]) for i in range(len(rows))]
    filled = water_fill(ns, ws, share * sum(ns), Fraction(max_repeats)) if sum(ns) else [Fraction(0)] * len(rows)
    whole, at, out = sum(filled) or Fraction(1), Fraction(0), []
    for i, (r, n, t) in enumerate(zip(rows, ns, filled, strict=True)):
        out.append((i, r["source"], n, float(t), int(t + Fraction(1, 2)), float(at / whole), float((at + t) / whole)))
        at += t
    schema = "sid int, source string, source_size long, target double, wanted long, low double, high double"
    return sizes.sparkSession.createDataFrame(out, schema)


def needed_slots(size: int, target: int, block_tokens: int) -> int:
    """Slots after which a source has given its target: whole passes, then blocks of the last one."""
    if not size:
        return 0
    passes, rest = divmod(target, size)
    return passes * -(-size // block_tokens) + -(-rest // block_tokens)


def schedule(spark: SparkSession, plan: list, block_tokens: int) -> DataFrame:
    """slot, sid, rank: which source each slot reads, and which of the source's slots it is (from 0).

    Where the points leave a source some slots short (they stray by a few at most, and the last block of a pass is
    smaller), the missing ones follow at the end.
    """
    n = int(-(-sum(r["target"] for r in plan) // block_tokens))
    coarse = (1 << 20) * GOLDEN % 1
    k = F.col("id")
    point = (F.floor(k / (1 << 20)) * coarse + (k % (1 << 20)) * GOLDEN) % 1
    slots = spark.range(n).select(k.alias("slot"), point.alias("point"), F.floor(k / CHUNK_SLOTS).alias("chunk"))
    highs = F.array(*[F.lit(r["high"]) for r in plan]) if plan else F.array().cast("array<double>")
    # the first source whose cumulative share passes the point
    sid = F.least(F.size(F.filter(highs, lambda h: h <= F.col("point"))), F.lit(max(len(plan) - 1, 0)))
    slots = slots.select("slot", "chunk", sid.cast("int").alias("sid"))
    local = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    per_chunk = slots.groupBy("sid", "chunk").count()
    before = F.sum("count").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("count")
    offsets = per_chunk.select("sid", "chunk", before.alias("before"))
    ranked = slots.withColumn("local", local).join(offsets, ["sid", "chunk"])
    ranked = ranked.select("slot", "sid", (F.col("before") + F.col("local")).cast("long").alias("rank"))
    wanted = [(r["sid"], needed_slots(r["source_size"], r["wanted"], block_tokens)) for r in plan]
    wanted = spark.createDataFrame(wanted, "sid int, needed long")
    have = per_chunk.groupBy("sid").agg(F.sum("count").alias("have"))
    short = F.broadcast(wanted).join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.where("have < needed").withColumn("rank", F.explode(F.expr("sequence(have, needed - 1)")))
    return ranked.unionByName(short.select((n + F.col("rank") * len(plan) + F.col("sid")).alias("slot"), "sid", "rank"))


def streams(sizes: DataFrame, table: DataFrame, n_docs: int) -> DataFrame:
    """sizes plus sid and start: the place of each document in its source's shuffled token stream."""
    buckets = max(1, n_docs // BUCKET_ROWS)
    keyed = sizes.join(F.broadcast(table.select("sid", F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s")))
    bucket = F.floor((F.shiftrightunsigned("h", 1) / float(1 << 63)) * buckets).cast("int")
    keyed = keyed.drop("_s").withColumn("bucket", F.least(bucket, F.lit(buckets - 1)))
    within = F.sum("size").over(
        Window.partitionBy("sid", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    totals = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("t"))
    totals = totals.select("sid", "bucket", (F.sum("t").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("t")).alias("before"))
    placed = keyed.withColumn("within", within).join(totals, ["sid", "bucket"])
    return placed.select("doc_id", "sid", "size", (F.col("before") + F.col("within")).alias("start"), "h")


def mix(
    docs: DataFrame,
    share: Fraction = Fraction(3, 2),
    weights: tuple[int, ...] = (3, 1, 2),
    max_repeats: int = 2,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(documents, order).

    documents: row, doc_id, source, size, source_size, target, taken; a row for each row of docs.
    order: slot, row, doc_id, offset, tokens; the pieces of documents that each slot of the mix reads.
    """
    spark = docs.sparkSession
    sizes = staged(sized(docs, text, source, doc_id, seed), "sizes")
    table = targets(sizes, share, weights, max_repeats)
    plan = sorted(table.collect(), key=lambda r: r["sid"])
    placed = streams(sizes, table, sizes.count())
    # identical rows share their key: a row id tells them apart in the order
    placed = staged(placed.withColumn("row", F.monotonically_increasing_id()), "streams")
    pieces = _pieces(placed, block_tokens)
    of = F.broadcast(spark.createDataFrame([tuple(r) for r in plan], table.schema).select("sid", "source_size", "wanted"))
    slots = schedule(spark, plan, block_tokens).join(of, "sid")
    blocks = F.ceil(F.col("source_size") / block_tokens)
    slots = slots.where(blocks > 0).withColumn("block", F.col("rank") % blocks).withColumn("pass", F.floor(F.col("rank") / blocks))
    # what the source has given before this slot; the slot that passes the target reads a part, later ones nothing
    given = F.col("pass") * F.col("source_size") + F.col("block") * block_tokens
    slots = slots.withColumn("allowed", F.col("wanted") - given).where((F.col("pass") < max_repeats) & (F.col("allowed") > 0))
    read = slots.select("slot", "sid", "block", "allowed").join(pieces, ["sid", "block"])
    tokens = F.least("tokens", F.greatest(F.col("allowed") - F.col("in_block"), F.lit(0)))
    order = read.select("slot", "row", "doc_id", "offset", tokens.alias("tokens")).where("tokens > 0")
    taken = order.groupBy("row").agg(F.sum("tokens").alias("taken"))
    info = F.broadcast(table.select("sid", "source", "source_size", "target"))
    documents = placed.join(info, "sid").join(taken, "row", "left")
    documents = documents.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return documents, order


def _pieces(placed: DataFrame, block_tokens: int) -> DataFrame:
    """The part of each document in each block: sid, block, row, doc_id, offset in the document, tokens, place in the block."""
    b, start, end = F.lit(block_tokens), F.col("start"), F.col("start") + F.col("size")
    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / b), F.floor((end - 1) / b))))
    low, high = F.greatest(start, F.col("block") * b), F.least(end, (F.col("block") + 1) * b)
    return spans.select(
        "sid", "block", "row", "doc_id", (low - start).alias("offset"), (high - low).alias("tokens"), (low - F.col("block") * b).alias("in_block")
    )
