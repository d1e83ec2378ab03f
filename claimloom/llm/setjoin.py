"""Exact set-similarity join by rare prefixes."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.lineage import cut


def ordered(sets: DataFrame, key: str, tokens: str, frequency: DataFrame) -> DataFrame:
    """``key``, ``_set`` (tokens, globally rarest first) and ``_size`` of every non-empty set."""
    rows = sets.select(key, F.explode(F.array_distinct(tokens)).alias("_token")).where("_token IS NOT NULL")
    placed = rows.join(frequency, "_token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "_token"))).alias("_at"))
    return placed.select(key, F.col("_at._token").alias("_set"), F.size("_at").alias("_size"))


def jaccard_join(left: DataFrame, right: DataFrame | None, key: str, tokens: str, threshold: Fraction | str | float, also: Callable[[Column, Column], Column] | None = None, lost: tuple[int, int] | None = None) -> DataFrame:
    """All pairs of sets with Jaccard similarity of at least ``threshold`` (above 0): ``left_key``, ``right_key``, ``jaccard``.

    Tokens are ordered by global rarity; only the rare prefix of each set, which a similar set must meet, is joined.
    Candidates carry key, size and place only; those that pass the length and positional filters get their sets back, and are verified exactly.
    ``right=None`` joins ``left`` with itself, each pair once, left_key < right_key. ``also`` is a further condition on the two keys of verified pairs.
    ``lost`` says what ``also`` implies, and shortens the prefixes: either each set lacks at most ``lost[0]`` tokens of its own in the other, or one of them at most ``lost[1]``.
    Keys must be unique; null keys, null and empty sets have no partner.
    """
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    own = right is None
    keep = lambda df: df.where(F.col(key).isNotNull()).select(key, tokens)
    left = keep(left)
    right = left if own else keep(right)
    every = left if own else left.unionByName(right)
    frequency = every.select(F.explode(F.array_distinct(tokens)).alias("_token")).where("_token IS NOT NULL").groupBy("_token").agg(F.count("*").alias("_n"))
    n, d = t.numerator, t.denominator
    ceiling = lambda x, a, b: F.ceil((x * a) / F.lit(float(b)) - 1e-9).cast("int")
    whole_left = cut(ordered(left, key, tokens, frequency))
    whole_right = whole_left if own else cut(ordered(right, key, tokens, frequency))

    def begun(df: DataFrame, name: str) -> DataFrame:
        prefix = F.slice("_set", 1, F.col("_size") - ceiling(F.col("_size"), n, d) + 1)
        return df.select(F.col(key).alias(f"{name}_key"), F.col("_size").alias(f"{name}_size"), F.posexplode(prefix).alias(f"{name}_pos", "_token"))

    small, large = F.least("left_size", "right_size"), F.greatest("left_size", "right_size")
    needed = ceiling(F.col("left_size") + F.col("right_size"), n, n + d)
    reachable = F.least(F.col("left_size") - F.col("left_pos"), F.col("right_size") - F.col("right_pos"))
    fits = (small * d >= large * n) & (reachable >= needed)
    begun_left, begun_right = begun(whole_left, "left"), begun(whole_right, "right")
    if lost is None:
        met = begun_left.join(begun_right, "_token").where(fits)
    else:  # the rarest common token is among the first of each set, or among the very first of one
        first = lambda df, name, most: df.where(F.col(f"{name}_pos") <= most)
        near, inside = lost
        met = first(begun_left, "left", max(near, inside)).join(first(begun_right, "right", near), "_token").where(fits)
        met = met.unionByName(first(begun_left, "left", inside).join(begun_right.where(F.col("right_pos") > near), "_token").where(fits))
        met = met.unionByName(begun_left.where(F.col("left_pos") > max(near, inside)).join(first(begun_right, "right", inside), "_token").where(fits))
    few = (met.where("left_key < right_key") if own else met).select("left_key", "right_key").distinct()
    sets = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.col("_set").alias(f"{name}_set"))
    pairs = few.join(sets(whole_left, "left"), "left_key").join(sets(whole_right, "right"), "right_key")
    pairs = pairs.withColumn("_common", F.size(F.array_intersect("left_set", "right_set"))).withColumn("_union", F.size("left_set") + F.size("right_set") - F.col("_common"))
    similar = pairs.where(F.col("_common") * d >= F.col("_union") * n).select("left_key", "right_key", (F.col("_common") / F.col("_union")).alias("jaccard"))
    return similar if also is None else similar.where(also(F.col("left_key"), F.col("right_key")))
