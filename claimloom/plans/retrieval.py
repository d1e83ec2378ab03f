"""The question pipeline: spans, entities, paths, ranking, passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.similarity import composite_score_from, ratio_score
from claimloom.functions.text import ngrams, tokens
from claimloom.functions.vector import cosine, literal
from claimloom.lineage import cut
from claimloom.operators import graph, ranking


def literal_names(spark: SparkSession, names: list[str]) -> DataFrame:
    """``pos``, ``name`` of a few names, made in the JVM."""
    return spark.range(0, 1, 1, 1).select(F.posexplode(F.array(*(F.lit(n) for n in names))).alias("pos", "name"))


def spans(spark: SparkSession, question: str) -> DataFrame:
    """``span``, ``n``, ``at``: the distinct token n-grams of a question, each in its first casing."""
    rows = spark.range(0, 1, 1, 1).select(F.explode(ngrams(F.lit(question))).alias("g")).select("g.*")
    first = Window.partitionBy(F.lower("span")).orderBy("n", "at")
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def match_entities(question_spans: DataFrame, entities: DataFrame, score: float = config.MATCH_SCORE, top: int = config.MATCH_TOP, coverage: float = config.MATCH_COVERAGE) -> DataFrame:
    """``canonical_name``, ``score``: the entities whose name or alias a span resembles, best first, ties by name.

    A span must have at least ``coverage`` of the name's tokens. Names under five letters are compared strictly, others by the composite ratio.
    The spans of one question are few; where their count says so, they are broadcast to the names, and the registry is read once.
    """
    parallel = entities.sparkSession.sparkContext.defaultParallelism  # scores cost more than moving the names
    names = entities.repartition(parallel).select("canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name <> ''")
    needed = F.ceil(F.size(tokens(F.col("name"))) * coverage)
    few = question_spans.select("span", F.size(F.split("span", " ")).alias("_size"))
    few = F.broadcast(few) if few.limit(MOST_SPANS + 1).count() <= MOST_SPANS else few
    pairs = names.withColumn("_needed", needed).join(few, F.col("_size") >= F.col("_needed"))
    a, b = F.lower("span"), F.lower("name")
    scored = pairs.withColumn("score", F.when(F.length("name") < 5, ratio_score(a, b)).otherwise(composite_score_from(score)(a, b)))
    best = scored.groupBy("canonical_name").agg(F.max("score").alias("score")).where(F.col("score") >= score)
    return best.orderBy(F.desc("score"), "canonical_name").limit(top)


#: Spans of a question that may be broadcast.
MOST_SPANS = 10_000
CARRIED = ["claim_signature", "source_name", "relation_type", "target_name", "certainty_max", "paper_count", "quality", "cosine"]


def scored_claims(claims: DataFrame, evidence: DataFrame, query: list[float]) -> DataFrame:
    """Claims with ``quality`` (all of their evidence counts for the section weight) and ``cosine`` to the query; 0 without a usable vector."""
    best = graph.section_best(evidence)
    rows = claims.join(best, "claim_signature", "left")
    quality = ranking.claim_quality(F.col("certainty_max"), F.col("paper_count"), F.col("study_weight_max"), F.col("section_weight"))
    similar = cosine(F.col("embedding"), literal(query))
    return rows.withColumn("quality", quality).withColumn("cosine", F.when(F.size("embedding") == len(query), F.coalesce(F.nanvl(similar, F.lit(0.0)), F.lit(0.0))).otherwise(0.0))


def question_claims(claims: DataFrame, evidence: DataFrame, names: list[str], query: list[float]) -> DataFrame:
    """The scored claims that paths about some entities can hold, with what the paths carry of them."""
    near = graph.touching(claims, names)
    said = evidence.join(near.select("claim_signature"), "claim_signature", "left_semi")
    return cut(scored_claims(near, said, query).select(*CARRIED, *(f"n_{p}" for p in config.EDGE_POLARITIES)))  # the question's, read three times by paths


def candidate_paths(claims: DataFrame, names: list[str], generic: list[str] | None = None, hops: int = 2) -> DataFrame:
    """Direct paths and chains of matched entities: ``path_signature``, ``length``, ``entities``, ``relations``, ``quality`` (product), ``cosine`` (mean)."""
    spark = claims.sparkSession
    direct = graph.one_hop(claims, names, generic).select(F.col("claim_signature").alias("path_signature"), F.lit(1).alias("length"), F.array("source_name", "target_name").alias("entities"), F.array("relation_type").alias("relations"), "quality", "cosine")
    if hops < 2 or len(names) < 2:
        return direct
    matched = literal_names(spark, names)
    chains = graph.two_hop(claims, graph.anchor_pairs(matched, generic), CARRIED, generic, known_pairs=len(names) ** 2)
    chains = chains.select("path_signature", F.lit(2).alias("length"), F.array("source_name", "bridge_name", "target_name").alias("entities"), F.array("c1_relation_type", "c2_relation_type").alias("relations"), (F.col("c1_quality") * F.col("c2_quality")).alias("quality"), ((F.col("c1_cosine") + F.col("c2_cosine")) / 2).alias("cosine"))
    return graph.merge_paths(direct, chains)


def final_paths(claims: DataFrame, evidence: DataFrame, names: list[str], query: list[float], generic: list[str] | None = None) -> DataFrame:
    """The ranked paths about matched entities: pre-filter by quality, re-rank by cosine, quotas.

    The names cut the claims before they meet evidence or vectors, so neither the graph nor its evidence is scored or written for a question.
    """
    generic = config.GENERIC_ENTITIES if generic is None else generic
    specific = [n for n in names if n not in generic]
    paths = cut(candidate_paths(question_claims(claims, evidence, names, query), names, generic))  # the question's, read several times below
    kept = ranking.pre_filter(paths, specific, names)
    hybrid = kept.withColumn("hybrid", F.col("cosine")).withColumn("both_ends", ranking.has_both_ends(F.col("entities"), names))
    return ranking.quotas(hybrid)


def ask(question: str, entities: DataFrame, claims: DataFrame, evidence: DataFrame, query: list[float], generic: list[str] | None = None) -> DataFrame:
    """Question to final paths. The at most ten matched names are read to the driver: they become predicates of the graph scan."""
    found = match_entities(spans(entities.sparkSession, question), entities)
    return final_paths(claims, evidence, [r[0] for r in found.collect()], query, generic)
