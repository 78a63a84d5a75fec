"""URL filters: host-suffix and path-prefix expressions of each URL, equi-joined with the rules on a short hash.

A rule is (host, path, action). It fits its host and all subdomains where the URL's path starts with the rule's path.
Each URL is expanded into the expressions `host suffix + path prefix` of the shapes (labels in the host, length of the
path) that the rules have; no other expression could equal a rule. Expressions meet rules on the first 8 hex digits of
SHA-256, then the full digest confirms. The longest rule wins; of two equally long ones that with more path; of equal
rules with both actions, block.

Up to `broadcast_rules` rules of up to LOOKUP_SHAPES shapes (counted, not assumed) are broadcast, one lookup per shape: one
pass over the URLs without a shuffle, so hot hosts cost nothing. Beyond that, the distinct (host, path) pairs are exploded
and shuffle-joined, short expressions that many URLs share with copies of the rules; both ways give the same verdicts.

Defined results: a null URL and one without `://` have empty host and path, fit no rule and get the default verdict;
an empty rule list gives everyone the default; repeated rows are judged alike; rules with nulls, and such with neither host
nor path, are ignored; very long hosts, paths and rules are compared whole; an empty table gives an empty result; all other
columns stay, whatever their names, but for host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are broadcast (under 200 bytes each).
BROADCAST_RULES = 100_000
#: With more (labels, path length) shapes than this, the exploded form is used.
LOOKUP_SHAPES = 64
#: With more shapes than this, every prefix of a path is an expression.
BROADCAST_SHAPES = 10_000
#: Copies of a rule that the URLs are dealt to.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that make the join key.
PREFIX = 8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _prepared(rules: DataFrame) -> DataFrame:
    """Distinct rules with their shape and digest."""
    plain = rules.select("host", "path", "action").na.drop().where((F.col("host") != "") | (F.col("path") != ""))
    one = plain.groupBy("host", "path").agg(F.max(F.col("action") == "block").alias("block"))
    text = F.concat("host", "path")
    return one.select(
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("path_length"),
        text.alias("rule"),
        F.when(F.col("block"), "block").otherwise("allow").alias("action"),
        F.sha2(F.concat_ws("\x00", "host", "path"), 256).alias("digest"),
    )


def _expression(labels: Column, path_length: Column) -> Column:
    """Digest of the URL's expression of a shape; null where the URL is too short for it."""
    host, path = F.col("host"), F.col("path")
    # substring_index gives the whole host where it has fewer labels; such an expression has another shape
    enough = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= path_length)
    suffix = F.call_function("substring_index", host, F.lit("."), -labels)
    return F.when(enough, F.sha2(F.concat_ws("\x00", suffix, F.substring(path, F.lit(1), path_length)), 256))


def _rank() -> Column:
    return F.struct(F.length("rule").alias("n"), F.col("path_length").alias("p"), "rule", "action")


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """pages plus host, path, rule and verdict; columns of these names are replaced."""
    mine = ["host", "path", "rule", "verdict"]
    others = [c for c in pages.columns if c not in mine]
    # the page's own columns travel packed, so that none can clash with those of the joins
    row = F.struct(*others) if others else F.struct(F.lit(None).alias("_"))
    parsed = pages.select(row.alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    table = _prepared(rules)
    shapes = table.groupBy("labels", "path_length").count().limit(LOOKUP_SHAPES + 1).collect()
    few = len(shapes) <= LOOKUP_SHAPES and table.limit(broadcast_rules + 1).count() <= broadcast_rules
    found = _looked_up(parsed, table, shapes) if few else _joined(parsed, table, table.select("labels", "path_length").distinct())
    return found.select(
        *([F.col("_row").getField(c).alias(c) for c in others]),
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )


def _looked_up(parsed: DataFrame, table: DataFrame, shapes: list) -> DataFrame:
    best = []
    for k, s in enumerate(shapes):
        # one row for each short hash, so that the lookup never multiplies URLs
        of_shape = table.where((F.col("labels") == s["labels"]) & (F.col("path_length") == s["path_length"]))
        keyed = of_shape.groupBy(F.substring("digest", 1, PREFIX).alias(f"_k{k}")).agg(
            F.collect_list(F.struct("digest", _rank().alias("of"))).alias(f"_r{k}")
        )
        parsed = parsed.withColumn(f"_d{k}", _expression(F.lit(s["labels"]), F.lit(s["path_length"])))
        parsed = parsed.withColumn(f"_k{k}", F.substring(f"_d{k}", 1, PREFIX))
        parsed = parsed.join(F.broadcast(keyed), f"_k{k}", "left")
        best.append(F.expr(f"get(filter(_r{k}, r -> r.digest = _d{k}), 0).of"))
    if not best:
        return parsed.withColumn("_best", F.lit(None).cast("struct<n:int,p:int,rule:string,action:string>"))
    return parsed.withColumn("_best", reduce(lambda a, b: F.greatest(a, b), best) if len(best) > 1 else best[0])


def _joined(parsed: DataFrame, table: DataFrame, shapes: DataFrame) -> DataFrame:
    keys = parsed.select("host", "path").distinct()
    suffixes = keys.withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))))
    if shapes.limit(BROADCAST_SHAPES + 1).count() <= BROADCAST_SHAPES:
        lengths = shapes.groupBy("labels").agg(F.collect_list("path_length").alias("lengths"))
        exploded = suffixes.join(F.broadcast(lengths), "labels").withColumn("path_length", F.explode("lengths"))
    else:
        # rules of so many shapes: every prefix of the path
        exploded = suffixes.withColumn("path_length", F.explode(F.sequence(F.lit(0), F.length("path"))))
    exploded = exploded.withColumn("digest", _expression(F.col("labels"), F.col("path_length"))).where("digest IS NOT NULL")
    # many URLs share short expressions such as `com/`: each of them meets one of SALTS copies of the rules
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    left = exploded.select("host", "path", "digest", F.substring("digest", 1, PREFIX).alias("_k"), salt.alias("_s"))
    right = table.select(F.col("digest").alias("_full"), F.substring("digest", 1, PREFIX).alias("_k"), _rank().alias("of"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    hits = left.join(right, ["_k", "_s"]).where(F.col("digest") == F.col("_full"))
    best = hits.groupBy("host", "path").agg(F.max("of").alias("_best"))
    # URLs without host and path fit no rule; as one key of the join they might be very many
    some = (F.col("host") != "") | (F.col("path") != "")
    none = parsed.where(~some).withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType))
    return parsed.where(some).join(best, ["host", "path"], "left").select(*parsed.columns, "_best").unionByName(none)
