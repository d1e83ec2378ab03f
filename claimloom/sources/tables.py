"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``directory/name.parquet``, a file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _hashable(name: str, kind: str) -> Column | None:
    """A column as something that can be hashed: a map as its sorted entries; null where that is not possible."""
    if kind.startswith("map<") and "map<" not in kind[4:] and "variant" not in kind:
        return F.array_sort(F.map_entries(f"`{name}`"))
    return None if "map<" in kind or "variant" in kind else F.col(f"`{name}`")


def current_rows(df: DataFrame, key: str, time: str, *prefer: Column) -> DataFrame:
    """One row for each non-null ``key``: the latest by ``time``; exact copies count once.

    ``prefer`` ranks rows before the time does. Among rows of equal time the choice is fixed by a hash over the columns of ``df``
    (a map counts by its sorted entries), so it does not depend on file order; give only the columns that are needed, as all of them are read.
    Rows with a null key are dropped; a null time is the oldest.
    """
    plain = [c for c in (_hashable(*x) for x in df.dtypes) if c is not None]
    order = [*prefer, F.col(time).desc_nulls_last(), F.xxhash64(*plain)]
    window = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")
