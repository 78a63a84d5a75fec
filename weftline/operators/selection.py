"""Deterministic sampling: reservoirs, quotas over sources in order, round-robin, largest remainders, split allocation."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.staging import staged


def rank_digest(raw_sha256: Column, source: Column, seed: int) -> Column:
    """Digest of the canonical {raw_sha256, seed, source}; fixed-width hex sorts as the number it stands for."""
    fields = F.struct(raw_sha256.alias("raw_sha256"), F.lit(seed).alias("seed"), source.alias("source"))
    return F.sha2(F.to_json(fields), 256)


def reservoir(rows: DataFrame, size: int, source: str = "source", rank: str = "rank", node: str = "node") -> DataFrame:
    """The rows of the `size` smallest ranks of each source, with position from 1; at equal ranks the larger node stays.

    row_number with a limit becomes a partial limit in each task before the shuffle, so a hot source sends few rows.
    """
    cut = F.row_number().over(Window.partitionBy(source).orderBy(rank, F.desc(node)))
    kept = rows.withColumn("_cut", cut).where(F.col("_cut") <= size).drop("_cut")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(source).orderBy(rank, node)))


def greedy_quota(candidates: DataFrame, quotas: list[tuple[str, int]]) -> DataFrame:
    """Candidates (source, group, position, node, ...) selected by sources in the given order.

    Each source takes its first candidates of groups that no source before it took, until its quota. What a source
    didn't reach stays for the next one, so sources are a loop (over the registry, not over rows); each step is one
    distributed plan over candidates bounded by the reservoirs.
    """
    taken = None
    for source, quota in quotas:
        own = candidates.where(F.col("source") == source)
        if taken is not None:
            own = own.join(taken.select("group"), "group", "left_anti")
        first = F.row_number().over(Window.partitionBy("group").orderBy("position", "node"))
        own = own.withColumn("_f", first).where("_f = 1").drop("_f")
        picked = own.orderBy("position", "node").limit(quota)
        taken = staged(picked if taken is None else taken.unionByName(picked), "selected")
    return taken if taken is not None else candidates.limit(0)


def quota_balance(selected: DataFrame, quotas: list[tuple[str, int]]) -> DataFrame:
    """source, n, missing of all quotas: rows given, and what lacks of the quota; below 0 where a source gave more."""
    want = selected.sparkSession.createDataFrame(quotas, "source string, quota long")
    have = selected.groupBy("source").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(want).join(have, "source", "left").select("source", n.alias("n"), (F.col("quota") - n).alias("missing"))


def shortfall_table(selected: DataFrame, quotas: list[tuple[str, int]]) -> DataFrame:
    """source, missing: what each source gave less than its quota; only sources that did."""
    return quota_balance(selected, quotas).select("source", "missing").where("missing > 0")


def shortfall_gate(selected: DataFrame, quotas: list[tuple[str, int]], allowed: bool = False) -> None:
    """An error where a source fell short, unless that is allowed. One row for each quota is looked at."""
    if not allowed and (short := shortfall_table(selected, quotas).collect()):
        raise ValueError(f"sources fell short: {sorted(tuple(r) for r in short)}")


def round_robin(rows: DataFrame, limit: int | None = None, source: str = "source", order: tuple[str, ...] = ("digest",)) -> DataFrame:
    """rows plus turn: one of each source in name order, then the next of each, up to limit rows.

    Only the first `limit` of a source can be taken, which bounds what a hot source sends.
    """
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    placed = rows.withColumn("turn", turn)
    if limit is None:
        return placed
    return placed.where(F.col("turn") <= limit).orderBy("turn", source).limit(limit)


def first_of_group(rows: DataFrame, group: str, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def exclusive_batch(jobs: DataFrame, size: int, slot: str = "slot", *order: str) -> DataFrame:
    """At most one job of each slot, at most size jobs."""
    return first_of_group(jobs, slot, *order).orderBy(*order).limit(size)


def largest_remainder(total: int, shares: dict[str, Fraction]) -> dict[str, int]:
    """Whole parts of total by share; what rounding leaves goes to the largest remainders, ties by order."""
    exact = {k: total * s / sum(shares.values()) for k, s in shares.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: out[k] - exact[k])[: total - sum(out.values())]:
        out[k] += 1
    return out


def allocations(shares: DataFrame, total: int) -> DataFrame:
    """name, n of a table (name, share, place): largest remainders as one window over the table of names."""
    exact = F.col("share") * total
    base = shares.withColumn("whole", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    w = Window.orderBy(F.desc("rest"), "place")
    left = total - F.sum("whole").over(Window.partitionBy())
    return base.withColumn("extra", (F.row_number().over(w) <= left).cast("int")).select("name", (F.col("whole") + F.col("extra")).cast("long").alias("n"))


def split_at(position: Column, room: dict[str, int], priority: dict[str, float]) -> Column:
    """The split that takes the group at a position (from 0), where each group in turn goes to the split with the most room.

    A split with room r is chosen once at each of the levels r, r - 1, ..., 1. Between two neighbouring rooms the same
    splits are open, by falling priority, so there the position counts through them in turn. That gives one case for each
    distinct room, however many groups there are. Null beyond the last room.
    """
    open_, start, end = [], 0, F.lit(None).cast("string")
    levels = sorted({r for r in room.values() if r > 0}, reverse=True)
    cases = []
    for level, below in zip(levels, [*levels[1:], 0], strict=True):
        open_ = sorted((s for s in room if room[s] >= level), key=lambda s: -priority[s])
        cases.append((start, list(open_)))
        start += (level - below) * len(open_)
    for first, names in cases:
        turn = F.pmod(position - first, F.lit(len(names))).cast("int")
        end = F.when(position >= first, F.get(F.array(*map(F.lit, names)), turn)).otherwise(end)
    return F.when(position < start, end)


def allocate_splits(groups: DataFrame, fractions: dict[str, float], seed: int, holdout_family: str, holdout_split: str) -> DataFrame:
    """group, split, evaluation_slice of a table (group, families).

    Groups with the holdout family go to its split (slice `source_holdout`), the others by digest order (slice
    `in_distribution`). A group's position in digest order comes from a distributed sort, its split is an expression of
    the position. Only counts reach the driver.
    """
    spark = groups.sparkSession
    marked = groups.select("group", F.coalesce(F.array_contains("families", holdout_family), F.lit(False)).alias("held"))
    n, used = marked.agg(F.count("*"), F.coalesce(F.sum(F.col("held").cast("long")), F.lit(0))).first()
    names = spark.createDataFrame([(s, f, i) for i, (s, f) in enumerate(sorted(fractions.items()))], "name string, share double, place int")
    room = {r["name"]: r["n"] for r in allocations(names, n).collect()}
    room[holdout_split] -= used
    if room[holdout_split] < 0:
        raise ValueError("more groups with the holdout family than its split takes")
    as_text = F.to_json(F.array("group"))
    digest = F.sha2(F.concat(F.lit(f"[{seed},"), as_text.substr(F.lit(2), F.length(as_text) - 2), F.lit("]")), 256)
    placed = positions(marked.where("NOT held").select("group", digest.alias("digest")), "digest", "group")
    free = placed.select("group", split_at(F.col("position"), room, fractions).alias("split"), F.lit("in_distribution").alias("evaluation_slice"))
    return free.unionByName(marked.where("held").select("group", F.lit(holdout_split).alias("split"), F.lit("source_holdout").alias("evaluation_slice")))


def positions(rows: DataFrame, *order: str, per_bucket: int = 50_000) -> DataFrame:
    """rows plus position from 0 in the given order, without gathering them in one task.

    The leading column is a hex digest. Rows are bucketed by as many of its first digits as leave about per_bucket rows to
    a bucket; ranks within a bucket and totals of the buckets before it add up.
    """
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / per_bucket, 16)))
    bucket = F.substring(order[0], 1, digits)
    keyed = rows.withColumn("_b", bucket)
    totals = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = totals.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    ranked = keyed.withColumn("_w", within).join(before, "_b")
    return ranked.withColumn("position", F.col("_before") + F.col("_w")).drop("_b", "_w", "_before")
