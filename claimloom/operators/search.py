"""Exact nearest neighbours of one query vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.vector import cosine, literal


def wrong_vectors(rows: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """The rows whose vector is missing or has another length: a collection is sound where this is empty."""
    return rows.where(F.col(vector).isNull() | (F.size(vector) != dimensions))


def nearest_to(rows: DataFrame, vector: str, query: list[float], key: str, k: int = config.TOP_K) -> DataFrame:
    """The ``k`` rows most similar to ``query`` by cosine, with ``score``; ties go to the lower key. One scan, no shuffle but k rows a task."""
    scored = rows.where(F.size(vector) == len(query)).withColumn("score", cosine(F.col(vector), literal(query)))
    return scored.where(F.col("score").isNotNull() & ~F.isnan("score")).orderBy(F.desc("score"), key).limit(k)
