"""Ranking of paths: quality, pre-filter in buckets, hybrid score, quotas.

A *path table* has path_signature (unique), length (1, 2), entities (array), and the scores a step needs. Candidates of a hub entity may be many, so
they are cut by top-k limits, which work before the shuffle; what is broadcast or numbered in one task is bounded by the limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.text import or_default, weight


def claim_quality(certainty: Column, papers: Column, study_weight: Column, section_weight: Column) -> Column:
    """certainty x ln(1 + papers) x study x section; missing values weigh 'low', 0, 0.4 and 0.4, and so does a study weight of 0."""
    study = F.when(F.coalesce(study_weight, F.lit(0.0)) == 0, config.UNKNOWN_DESIGN).otherwise(study_weight)
    sure = weight(or_default(certainty, "low"), config.CERTAINTY_WEIGHTS, config.CERTAINTY_WEIGHTS["low"])
    return sure * F.log1p(F.coalesce(papers, F.lit(0))) * study * F.coalesce(section_weight, F.lit(config.UNKNOWN_SECTION))


def anchors(entities: Column, matched: list[str]) -> Column:
    """The matched entities of a path, in its order."""
    return F.filter(entities, lambda e: e.isin(matched))


def has_both_ends(entities: Column, matched: list[str]) -> Column:
    """Whether a path's first and last entity are matched."""
    return F.element_at(entities, 1).isin(matched) & F.element_at(entities, -1).isin(matched)


def pre_filter(paths: DataFrame, specific: list[str], matched: list[str], most: int = config.PRE_FILTER, bucket: int = config.BUCKET, chains: int = config.RESERVED_CHAINS) -> DataFrame:
    """The candidates for the hybrid stage: ``paths`` (with quality) plus ``bucket_name``.

    Kept are the best ``chains`` chains, every direct path between specific entities, and the best ``bucket`` paths of each specific entity; then
    the rest by quality up to ``most``. More than ``most`` kept ones all stay. Ties go by signature.
    """
    best = [F.desc("quality"), F.col("path_signature")]
    first = paths.where("length = 2").orderBy(*best).limit(chains).select("path_signature", F.lit(True).alias("_chain"))
    each = paths.select("path_signature", "quality", F.explode(F.array_distinct(F.filter(anchors(F.col("entities"), matched), lambda e: e.isin(specific)))).alias("_a"))
    top = each.withColumn("_n", F.row_number().over(Window.partitionBy("_a").orderBy(*best))).where(F.col("_n") <= bucket).select("path_signature").distinct().withColumn("_entity", F.lit(True))
    rows = paths.join(F.broadcast(first), "path_signature", "left").join(F.broadcast(top), "path_signature", "left")  # at most ``chains`` and ``bucket`` times the names
    direct = (F.col("length") == 1) & F.forall("entities", lambda e: e.isin(specific)) if specific else F.lit(False)
    name = F.when(F.col("_chain"), "chains").when(direct, "direct").when(F.col("_entity"), "entity")
    named = rows.withColumn("bucket_name", name).select(*paths.columns, "bucket_name")
    kept = named.where("bucket_name IS NOT NULL")
    rest = named.where("bucket_name IS NULL").orderBy(*best).limit(most).withColumn("_place", F.row_number().over(Window.orderBy(*best)))
    taken = kept.agg(F.count("*").alias("_n"))
    filled = rest.join(F.broadcast(taken), F.col("_place") <= most - F.col("_n")).select(*paths.columns, F.lit("quality").alias("bucket_name"))
    return kept.unionByName(filled)


def quotas(paths: DataFrame, score: str = "hybrid", direct: int = config.DIRECT_SLOTS, chains: int = config.CHAIN_SLOTS, most: int = config.TOP_K) -> DataFrame:
    """The final paths: ``direct`` direct paths and ``chains`` chains, free places going to the other kind, then the best ``most`` by score, with ``rank``.

    Within a kind, paths with both ends matched (column both_ends) come first. Ties go by signature.
    """
    order = Window.partitionBy("length").orderBy(F.desc("both_ends"), F.desc(score), "path_signature")
    rows = paths.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= direct + chains)  # no kind gets more
    count = lambda n: F.count_if(F.col("length") == n).over(Window.partitionBy())
    rows = rows.withColumn("_n1", count(1)).withColumn("_n2", count(2))
    first = F.least("_n1", F.lit(direct))
    second = F.least(F.col("_n2"), chains + (direct - first))
    first = first + F.least(F.col("_n1") - first, F.greatest(F.lit(0), chains - second))
    picked = rows.where(F.when(F.col("length") == 1, F.col("_n") <= first).otherwise(F.col("_n") <= second))
    rank = F.row_number().over(Window.orderBy(F.desc(score), "path_signature"))
    return picked.orderBy(F.desc(score), "path_signature").limit(most).withColumn("rank", rank).select(*paths.columns, "rank")
