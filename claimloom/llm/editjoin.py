"""Exact join of keys that differ by typing only, by rare 3-grams and beginnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.lineage import cut
from claimloom.llm.names import few_letters_differ, gram_set, grams, letters, same_but_for_typing
from claimloom.llm.setjoin import ordered


def _hash(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _cut_ends(whole: DataFrame, key: str, short: DataFrame, other: str, least: int) -> DataFrame:
    """``key``, ``other``: the keys of ``short`` that may be beginnings, of ``least`` characters or more, of a longer key of ``whole``. Beginnings carry a hash, not the key."""
    ends = F.when(F.length(key) > least, F.sequence(F.lit(least), F.length(key) - 1)).otherwise(F.array().cast("array<int>"))
    begun = whole.select(_hash("whole", F.col(key)).alias("_id"), F.explode(F.transform(ends, lambda n: _hash("whole", F.substring(key, F.lit(1), n)))).alias("_token"))
    return begun.join(short.select(other, _hash("whole", F.col(other)).alias("_token")), "_token").join(whole.select(key, _hash("whole", F.col(key)).alias("_id")), "_id").select(key, other)


def typing_join(left: DataFrame, right: DataFrame | None, key: str, threshold: str | float, edits: int = 2, least: int = 8) -> DataFrame:
    """All pairs that ``same_but_for_typing`` accepts and whose n-gram sets have a Jaccard similarity of at least ``threshold``: ``left_key``, ``right_key``, ``jaccard``.

    An edit changes three 3-grams of either key at most, so of its 3 ``edits`` + 1 rarest one is common; a cut key is a beginning of the other. Words of a
    fixed vocabulary are among the rarest of short keys only, so keys that share no more than these hardly meet; which pairs are found does not depend on it.
    Keys must be unique; null keys and keys without words have no partner. ``right=None`` joins ``left`` with itself, each pair once, left_key < right_key.
    """
    own = right is None
    some = lambda df, name: df.select(F.col(key).alias(name)).where(F.trim(name) != "")
    a, b = some(left, "left_key"), some(left if own else right, "right_key")
    sets = lambda df, name: df.select(name, gram_set(F.col(name)).alias("_grams"))
    every = sets(a, "left_key") if own else sets(a, "left_key").unionByName(sets(b.withColumnRenamed("right_key", "left_key"), "left_key"))
    frequency = cut(every.select(F.explode("_grams").alias("_token")).groupBy("_token").agg(F.count("*").alias("_n")))
    rarest = lambda df, name: ordered(sets(df, name), name, "_grams", frequency).select(name, letters(F.col(name)).alias(f"{name}_letters"), F.explode(F.slice("_set", 1, 3 * edits + 1)).alias("_token"))
    asked = cut(rarest(a, "left_key"))
    offered = asked.select(F.col("left_key").alias("right_key"), F.col("left_key_letters").alias("right_key_letters"), "_token") if own else rarest(b, "right_key")
    near = few_letters_differ(F.col("left_key_letters"), F.col("right_key_letters"), edits)
    met = asked.join(offered, "_token").where(near).select("left_key", "right_key")
    ends = _cut_ends(b, "right_key", a, "left_key", least)
    if own:
        met = met.where("left_key < right_key")  # a beginning is less than its key
    else:
        ends = ends.unionByName(_cut_ends(a, "left_key", b, "right_key", least))
    alike = same_but_for_typing(F.col("left_key"), F.col("right_key"), edits, least)
    few = cut(met.where(alike).unionByName(ends.where(alike)).distinct())
    scored = few.withColumn("_a", grams(F.col("left_key"))).withColumn("_b", grams(F.col("right_key")))
    scored = scored.withColumn("jaccard", F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b")))
    return scored.where(F.col("jaccard") >= F.lit(float(threshold)) - 1e-9).select("left_key", "right_key", "jaccard")
