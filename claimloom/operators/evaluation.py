"""Aggregates over judged answers and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import config


def judged(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates joined with the ground truth on id; those without truth or answer are left out. Truth has id, answer (as expected_answer)."""
    gold = truth.select("id", F.col("answer").alias("expected_answer"))
    return candidates.where(F.trim(F.coalesce("answer", F.lit(""))) != "").join(gold, "id")


def metric_means(scores: DataFrame, *by: str) -> DataFrame:
    """``metric``, ``mean``, ``n`` over the non-null scores (columns metric, score); a metric without any has a null mean."""
    return scores.groupBy(*by, "metric").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))


def four_metric_mean(*scores: Column) -> Column:
    """The mean of the scores, null unless all are there."""
    total = F.lit(0.0)
    for s in scores:
        total = total + s
    return total / len(scores)


def wide_scores(scores: DataFrame, key: str = "id") -> DataFrame:
    """One row for each item: its judged metrics as columns, and ``overall``, null unless all four are there."""
    wide = scores.groupBy(key).agg(*(F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in config.JUDGE_METRICS))
    return wide.withColumn("overall", four_metric_mean(*(F.col(m) for m in config.JUDGE_METRICS)))


def usage_totals(usage: DataFrame, by: str, *counters: str) -> DataFrame:
    """Sums of counters for each ``by`` and in total, the total's key being TOTAL."""
    return usage.rollup(by).agg(*(F.sum(c).alias(c) for c in counters), F.grouping(by).alias("_g")).withColumn(by, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(by))).drop("_g")


def run_summary(runs: DataFrame) -> DataFrame:
    """``runs``, ``failed``, ``total_s``, ``mean_s``, ``most_mb`` over run metrics (total_time_s, ram_mb, success)."""
    return runs.agg(F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failed"), F.sum("total_time_s").alias("total_s"), F.avg("total_time_s").alias("mean_s"), F.max("ram_mb").alias("most_mb"))


def hop_counts(paths: DataFrame) -> DataFrame:
    """``direct``, ``chains``: paths by length."""
    return paths.agg(F.count_if(F.col("length") == 1).alias("direct"), F.count_if(F.col("length") == 2).alias("chains"))
