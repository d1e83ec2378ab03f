"""Keyed upserts, skip-existing appends and quarantine of bad rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``stored`` overlaid by the last incoming row of each key by ``order``; columns that are missing on a side are null there.

    The incoming side is reduced to one row a key first, so the stored side meets it in one join and is never sorted.
    """
    window = Window.partitionBy(key).orderBy(F.desc(order))
    last = incoming.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")
    return stored.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def new_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The incoming rows whose key is not stored."""
    return incoming.join(stored.select(key), key, "left_anti")


def split_parsed(rows: DataFrame, parsed: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, rows for quarantine)."""
    return rows.where(F.col(parsed).isNotNull()), rows.where(F.col(parsed).isNull())


def overlay(defaults: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Template rows whose columns take the parsed value, also a parsed null, where the key was parsed. ``parsed`` may name the fields it holds in an
    array column ``fields``; then only those are taken over, as a field that a response leaves out keeps its default."""
    shared = [c for c in parsed.columns if c not in (key, "fields") and c in defaults.columns]
    given = F.col("fields") if "fields" in parsed.columns else F.array(*(F.lit(c) for c in shared)).cast("array<string>")
    own = parsed.select(key, given.alias("_given"), *(F.col(c).alias(f"_new_{c}") for c in shared))
    value = lambda c: F.when(F.array_contains("_given", F.lit(c)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return defaults.join(own, key, "left").select(*(value(c) if c in shared else F.col(c) for c in defaults.columns))


def changed_texts(claims: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose text differs from the stored one, or is not stored: what has to be embedded again."""
    old = stored.select(key, F.col(text).alias("_old"))
    return claims.join(old, key, "left").where(~F.col(text).eqNullSafe(F.col("_old"))).drop("_old")
