"""Connected components of an edge table, by alternating large and small stars; nothing comes to the driver but counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.staging import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (columns a and b, of any order, repeats and loops allowed).

    root is the smallest node that can be reached. Each round joins every node with the smallest of its neighbours, so
    depth halves from round to round; a hub's neighbours are split by the join, not gathered. Rounds end when no edge
    changes. An empty edge table gives an empty result; edges with a null end are ignored.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = staged(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(ends).alias("e")).select("e.*").where("a <> b").distinct()
        after = staged(small, "edges")
        if _mark(after) == _mark(now):
            rooted = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return rooted.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        discard(edges.sparkSession, now)
        now = after


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("a")).first())


def labelled(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """nodes plus root; a node without edges is its own root."""
    found = components(edges).withColumnRenamed("node", "_node")
    return nodes.join(found, F.col(node) == F.col("_node"), "left").withColumn("root", F.coalesce("root", node)).drop("_node")


def key_edges(keyed: DataFrame, node: str = "node", key: str = "key") -> DataFrame:
    """Edges from each node to the smallest node that shares a key with it: linear in the rows, also for a hot key.

    Keys are made once: they are read twice, from staged rows.
    """
    keyed = staged(keyed.select(node, key), "keys")
    owner = keyed.groupBy(key).agg(F.min(node).alias("b"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(owner, key).select(F.col(node).alias("a"), "b").where("a <> b").distinct()


def two_phase(nodes: DataFrame, edges: DataFrame, near: Callable[[DataFrame], DataFrame], order: tuple, node: str = "node") -> DataFrame:
    """nodes plus root: components of the exact edges, merged where their representatives are near each other.

    near: from representatives (one row of `nodes` for each exact component, the first by `order`) to pairs left, right.
    """
    exact = labelled(nodes, edges, node)
    firsts = exact.withColumn("_f", F.row_number().over(Window.partitionBy("root").orderBy(*order))).where("_f = 1").drop("_f")
    pairs = near(firsts).select(F.col("left").alias("a"), F.col("right").alias("b"))
    return labelled(nodes, edges.select("a", "b").unionByName(pairs), node)


def stable_group_id(members: DataFrame, group: str = "root", digest: str = "raw_sha256") -> DataFrame:
    """group, group_id: `g_` and the smallest digest of its members."""
    return members.groupBy(group).agg(F.concat(F.lit("g_"), F.min(digest)).alias("group_id"))


def reviewed_group_id(members: DataFrame, root: str = "root", group_id: str = "group_id") -> DataFrame:
    """root, reviewed_id: `rg_` and the digest of the sorted ids of the groups that a review merged."""
    ids = F.to_json(F.array_sort(F.collect_set(group_id)))
    return members.groupBy(root).agg(F.concat(F.lit("rg_"), F.sha2(ids, 256)).alias("reviewed_id"))


def quarantined(members: DataFrame, explored: str = "explored", root: str = "root") -> DataFrame:
    """root, quarantine: true where any member was explored."""
    return members.groupBy(root).agg(F.bool_or(explored).alias("quarantine"))


def usable(members: DataFrame, explored: str = "explored", root: str = "root") -> DataFrame:
    """Members of components that no explored member touches."""
    return members.join(quarantined(members, explored, root).where("quarantine").select(root), root, "left_anti")
