"""Conversations: messages as arrays, validity with reasons, prefixes within a budget, grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

ROLES = ("assistant", "system", "user")
#: Characters over all roles up to which a user turn may end a prefix.
BUDGET = 24_000


def assemble(rows: DataFrame) -> DataFrame:
    """conv_id, messages (array of role, content by turn) from one row for each turn."""
    packed = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    sorted_ = rows.groupBy("conv_id").agg(packed.alias("m"))
    return sorted_.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def user_texts(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])


def reject_reason(messages: Column) -> Column:
    """Null for a valid conversation; else the reason of its first bad message, or what it lacks."""
    bad_role = lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))
    blank = lambda m: F.coalesce(~m["content"].rlike(r"(?U)\S"), F.lit(True))
    first = F.get(F.filter(messages, lambda m: m.isNull() | bad_role(m) | blank(m)), F.lit(0))
    broken = F.exists(messages, lambda m: m.isNull() | bad_role(m) | blank(m))
    return (
        F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, "missing_messages")
        .when(broken & (first.isNull() | bad_role(first)), "unsupported_role")
        .when(broken, "empty_or_nontext_message")
        .when(~F.exists(messages, lambda m: m["role"] == "user"), "missing_user_turn")
    )


def eligible_turns(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """conv_id, index, role and running length of the turns within the budget (inclusive), index from 0.

    One window over a conversation's turns; a conversation is bounded by its budget, longer ones only lose turns.
    """
    return _within(rows, budget).select("conv_id", "index", "role", "running")


def _within(rows: DataFrame, budget: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("index", F.count("*").over(w) - 1).withColumn("running", F.sum(F.length("text")).over(w))
    return numbered.where(F.coalesce("running", F.lit(0)) <= budget)


def prefix_bounds(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """conv_id, first_index, last_index, n_prefixes: the first and the last user turn within the budget."""
    users = eligible_turns(rows, budget).where("role = 'user'")
    ends = users.groupBy("conv_id").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"))
    return ends.withColumn("n_prefixes", F.when(F.col("first_index") == F.col("last_index"), 1).otherwise(2))


def prefixes(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """conv_id, prefix_index, messages (from the start to the turn, inclusive), prefix_sha256.

    Turns beyond the budget leave before messages are put together, so no array is larger than the budget.
    """
    bounds = prefix_bounds(rows, budget).select("conv_id", F.explode(F.array_distinct(F.array("first_index", "last_index"))).alias("prefix_index"))
    cut = assemble(_within(rows, budget)).join(bounds, "conv_id").withColumn("messages", F.slice("messages", F.lit(1), F.col("prefix_index") + 1))
    body = F.to_json(F.transform("messages", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))))
    return cut.select("conv_id", F.col("prefix_index").cast("long").alias("prefix_index"), "messages", T.digest(body).alias("prefix_sha256"))


def exact_keys(conversations: DataFrame) -> DataFrame:
    """conv_id, kind, key: conversations that share a key belong together.

    users: all user texts; first: a substantial first one; document: a document that a user text quotes.
    """
    users = T.normal_all(user_texts(F.col("messages")))
    with_users = conversations.select("conv_id", "messages", users.alias("users")).where(F.size("users") > 0)
    first = F.when(F.length(F.get("users", F.lit(0))) >= T.ANCHOR_CHARS, T.digest(F.get("users", F.lit(0))))
    whole = with_users.select("conv_id", F.lit("users").alias("kind"), T.digest(T.canonical_strings(F.col("users"))).alias("key"))
    firsts = with_users.select("conv_id", F.lit("first").alias("kind"), first.alias("key")).where("key IS NOT NULL")
    each = with_users.select("conv_id", F.explode(user_texts(F.col("messages"))).alias("t"))
    documents = each.select("conv_id", F.lit("document").alias("kind"), T.digest(T.document_anchor(F.col("t"))).alias("key"))
    return whole.unionByName(firsts).unionByName(documents.where("key IS NOT NULL").distinct())


def in_splits(prefixes: DataFrame, parents: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """Prefixes (conv_id, group_id, ...) of conversations in the splits, with split and evaluation_slice of their parents.

    Prefixes of other splits, or without a parent, are left out; another group than the parent's is an error when read.
    """
    own = parents.where(F.col("split").isin(*splits)).select("conv_id", F.col("group_id").alias("_group"), "split", "evaluation_slice")
    joined = prefixes.join(own, "conv_id")
    agree = F.assert_true(F.col("group_id") == F.col("_group"), "a prefix is in another group than its conversation").isNull()
    return joined.where(agree).drop("_group")


def within_tokens(prefixes: DataFrame, most: int, tokens: str = "tokens") -> DataFrame:
    """Prefixes whose state has at most so many tokens."""
    return prefixes.where(F.col(tokens) <= most)
