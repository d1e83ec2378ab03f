"""Profiles of tables: counts, shares, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.text import line_count, section_plain, word_count


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """Each chunk's section, words, characters and lines. ``chunks`` has point_id, paper_id, chunk_filename, text."""
    stem = F.regexp_replace("chunk_filename", r"\.[^.]*$", "")
    return chunks.select("point_id", "paper_id", section_plain(stem).alias("section"), word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), line_count(F.col("text")).alias("line_count"))


def describe(rows: DataFrame, *columns: str) -> DataFrame:
    """``column_name``, ``count``, ``mean``, ``std`` (sample), ``min``, ``p25``, ``p50``, ``p75``, ``max`` (exact, interpolated); one scan for all columns."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *(F.percentile(c, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.max(c).cast("double").alias("max")) for c in columns]
    return rows.agg(F.array(*parts).alias("_all")).select(F.inline("_all"))


def percentiles(rows: DataFrame, column: str, points: list[int] | None = None) -> DataFrame:
    """``p``, ``value``: exact interpolated percentiles, cut to whole numbers. The aggregation keeps counts of distinct values, not rows."""
    points = points or config.PERCENTILES
    values = F.percentile(column, F.array(*(F.lit(p / 100) for p in points)))
    pairs = rows.agg(values.alias("_v")).select(F.posexplode("_v").alias("_i", "_x"))
    return pairs.select(F.element_at(F.array(*(F.lit(p) for p in points)), F.col("_i") + 1).alias("p"), F.floor("_x").alias("value"))


def threshold_sweep(rows: DataFrame, column: str, thresholds: list[int] | None = None) -> DataFrame:
    """``threshold``, ``n``, ``n_share``, ``total``, ``total_share``: how much lies above each threshold; all in one aggregation."""
    thresholds = thresholds or config.LENGTH_THRESHOLDS
    c = F.col(column)
    item = lambda t: F.struct(F.lit(t).alias("threshold"), F.count_if(c > t).alias("n"), (F.count_if(c > t) * 100.0 / F.count("*")).alias("n_share"), F.coalesce(F.sum(F.when(c > t, c)), F.lit(0)).alias("total"), (F.coalesce(F.sum(F.when(c > t, c)), F.lit(0)) * 100.0 / F.sum(c)).alias("total_share"))
    return rows.agg(F.array(*(item(t) for t in thresholds)).alias("_all")).select(F.inline("_all"))


def value_counts(rows: DataFrame, value: Column, name: str, top: int | None = None, share: bool = False) -> DataFrame:
    """``name``, ``n`` (and ``share`` of all rows in percent), most frequent first, ties by value; ``top`` makes it a top list."""
    out = rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    if share:
        out = out.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
    return out.orderBy(F.desc("n"), name).limit(top) if top else out


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin`` (from 1), ``n``: equal-width bins over the range, the greatest value in the last one; empty bins have no row."""
    span = rows.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1))
    return rows.where(F.col(column).isNotNull()).select(column).join(F.broadcast(span)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def null_counts(rows: DataFrame) -> DataFrame:
    """``column_name``, ``nulls`` of every column, in one scan."""
    return rows.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")) for c in rows.columns)).alias("_all")).select(F.inline("_all"))


def coverage(rows: DataFrame, column: str) -> DataFrame:
    """``filled``, ``rows``, ``share`` of the values that are not null, '' or 'null'."""
    good = F.count_if(F.coalesce(F.lower(F.trim(column)), F.lit("")).isin("", "null") == F.lit(False))
    return rows.agg(good.alias("filled"), F.count("*").alias("rows"), (good * 100.0 / F.count("*")).alias("share"))


def exploded_counts(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``name``, ``n``, ``share``: how many rows hold each element of an array, in percent of all rows, so shares add up to more than 100."""
    total = rows.agg(F.count("*").alias("_all"))
    each = rows.select(F.explode(F.array_distinct(column)).alias(name)).where(F.col(name).isNotNull())
    return each.groupBy(name).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(name, "n", (F.col("n") * 100.0 / F.col("_all")).alias("share"))


def size_distribution(rows: DataFrame, column: str) -> DataFrame:
    """``items`` (0, 1, 2, 3, 4+), ``n``: sizes of an array column; null counts as empty."""
    size = F.coalesce(F.size(F.when(F.col(column).isNotNull(), F.col(column))), F.lit(0))
    size = F.when(F.col(column).isNull(), 0).otherwise(size)
    return rows.groupBy(F.when(size >= 4, "4+").otherwise(size.cast("string")).alias("items")).agg(F.count("*").alias("n"))


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``n``."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def range_of(rows: DataFrame, *columns: str) -> DataFrame:
    """``column_name``, ``least``, ``greatest``, ``span`` of numeric columns."""
    item = lambda c: F.struct(F.lit(c).alias("column_name"), F.min(c).cast("bigint").alias("least"), F.max(c).cast("bigint").alias("greatest"), (F.max(c) - F.min(c)).cast("bigint").alias("span"))
    return rows.agg(F.array(*(item(c) for c in columns)).alias("_all")).select(F.inline("_all"))
