"""The evidence graph: vertices, edges, integrity, and one- and two-hop patterns.

A *claim table* here has claim_signature (unique), source_name, relation_type, target_name, n_positive, n_negative, n_hypothetical and whatever
else its paths should carry. Edges are derived from it, not stored: Spark joins on the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that occur more than once or hold a null, with their rows: a uniqueness constraint holds where this is empty."""
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | null)


def target_edges(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claim -> entity: the claims whose both ends are entities (column canonical_name); others have no edge."""
    names = entities.select("canonical_name").distinct()
    ends = claims.join(names, F.col("source_name") == F.col("canonical_name"), "left_semi").join(names, F.col("target_name") == F.col("canonical_name"), "left_semi")
    return ends.select("claim_signature", F.col("target_name").alias("canonical_name"))


def polarity_edges(claims: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Entity -> claim: ``canonical_name``, ``claim_signature``, ``polarity``, ``n`` for each polarity with a count; uncertain and mixed make no edge."""
    stacked = ", ".join(f"'{p}', n_{p}" for p in config.EDGE_POLARITIES)
    edges = claims.select("claim_signature", F.col("source_name").alias("canonical_name"), F.expr(f"stack({len(config.EDGE_POLARITIES)}, {stacked}) AS (polarity, n)")).where("n > 0")
    return edges if entities is None else edges.join(entities.select("canonical_name").distinct(), "canonical_name", "left_semi")


def reachable(claims: DataFrame) -> DataFrame:
    """The claims with a source edge: some positive, negative or hypothetical count."""
    return claims.where(F.col("n_positive") + F.col("n_negative") + F.col("n_hypothetical") > 0)


def one_hop(claims: DataFrame, names: list[str], generic: list[str] | None = None) -> DataFrame:
    """The direct paths of some entities: reachable claims one of whose ends is a named entity that is not generic.

    Claims between a specific and a generic entity are among them. Names that are all generic, or none, give no path. The names are a
    query's few; they become a literal predicate that reaches the scan.
    """
    generic = config.GENERIC_ENTITIES if generic is None else generic
    specific = [n for n in dict.fromkeys(names) if n not in generic]
    hit = F.col("source_name").isin(specific) | F.col("target_name").isin(specific) if specific else F.lit(False)
    return reachable(claims).where(hit)


def touching(claims: DataFrame, names: list[str]) -> DataFrame:
    """The reachable claims that a path about some entities can hold: those with an end among the names. A direct path has one there, and so has either claim of a chain."""
    return reachable(claims).where(F.col("source_name").isin(names) | F.col("target_name").isin(names) if names else F.lit(False))


def generic_specific(claims: DataFrame, names: list[str], generic: list[str] | None = None) -> DataFrame:
    """The reachable claims between a named specific and a named generic entity, either way: a subset of ``one_hop``."""
    generic = config.GENERIC_ENTITIES if generic is None else generic
    some, rest = [n for n in names if n in generic], [n for n in names if n not in generic]
    between = lambda a, b: F.col("source_name").isin(a) & F.col("target_name").isin(b)
    return reachable(claims).where(between(some, rest) | between(rest, some))


def anchor_pairs(names: DataFrame, generic: list[str] | None = None) -> DataFrame:
    """``start``, ``end``: pairs of matched entities (columns name, pos): specific with later specific, specific with generic."""
    generic = config.GENERIC_ENTITIES if generic is None else generic
    a = names.select(F.col("name").alias("start"), F.col("pos").alias("_p"), F.col("name").isin(generic).alias("_g"))
    b = names.select(F.col("name").alias("end"), F.col("pos").alias("_q"), F.col("name").isin(generic).alias("_h"))
    return a.join(b, ~F.col("_g") & (F.col("_h") | (F.col("_p") < F.col("_q")))).where("start <> end").select("start", "end")


def two_hop(claims: DataFrame, pairs: DataFrame, columns: list[str], generic: list[str] | None = None, most_pairs: int = 10_000, known_pairs: int | None = None) -> DataFrame:
    """The chains a -> c1 -> mid -> c2 -> b between the ends of each pair, in either direction, once each.

    The bridge is no end and not generic. First claims are those that leave an end, second claims those that reach one, so
    both sides are small before they meet at the bridge. ``pairs`` (start, end) is a query's few; it is broadcast if its size, counted unless ``known_pairs`` bounds it, allows, else joined.
    Output: ``columns`` of either claim as c1_*, c2_*, ``source_name``, ``bridge_name``, ``target_name``, ``path_signature``.
    """
    generic = config.GENERIC_ENTITIES if generic is None else generic
    both = pairs.select(F.col("start").alias("_a"), F.col("end").alias("_b")).unionByName(pairs.select(F.col("end").alias("_a"), F.col("start").alias("_b"))).distinct()
    if (both.limit(most_pairs + 1).count() if known_pairs is None else 2 * known_pairs) <= most_pairs:
        both = F.broadcast(both)
    alive = reachable(claims)
    take = lambda p: [F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys(["claim_signature", "source_name", "target_name", *columns])]
    first = alive.join(both, F.col("source_name") == F.col("_a")).where(~F.col("target_name").isin(generic)).select("_a", "_b", *take("c1"))
    second = alive.join(both.select("_b").distinct().withColumnRenamed("_b", "_end"), F.col("target_name") == F.col("_end"), "left_semi").select(*take("c2"))
    chains = first.join(second, (F.col("c1_target_name") == F.col("c2_source_name")) & (F.col("c2_target_name") == F.col("_b")))
    chains = chains.where("c1_target_name <> _a AND c1_target_name <> _b")
    signature = F.concat_ws(">>", "c1_claim_signature", "c2_claim_signature")
    named = chains.select(F.col("_a").alias("source_name"), F.col("c1_target_name").alias("bridge_name"), F.col("_b").alias("target_name"), signature.alias("path_signature"), *(c for c in chains.columns if c[:3] in ("c1_", "c2_")))
    return named.dropDuplicates(["path_signature"])


def ranked_evidence(evidence: DataFrame, papers: DataFrame, most: int | None = None) -> DataFrame:
    """Each claim's evidence with its paper, a row each, ``_nth`` from 1, best sections first, at most ``most``; evidence without a paper vanishes."""
    rank = section_rank(F.col("section_type"))
    order = [rank.desc(), F.col("paper_id"), F.col("evidence_id")]
    rows = evidence.where(F.coalesce("evidence_text", F.lit("")) != "").join(papers.select("paper_id", "study_design", F.col("published_year").alias("paper_year")), "paper_id")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("claim_signature").orderBy(*order)))
    return rows if most is None else rows.where(F.col("_nth") <= most)


def evidence_lists(evidence: DataFrame, papers: DataFrame, most: int) -> DataFrame:
    """``claim_signature``, ``evidence_list``: each claim's best ``most`` pieces of evidence, cut by rank before they are gathered."""
    item = F.struct("_nth", "evidence_text", "paper_id", "study_design", "paper_year", "section_type")
    return ranked_evidence(evidence, papers, most).groupBy("claim_signature").agg(F.array_sort(F.collect_list(item)).alias("evidence_list"))


def section_rank(section: Column) -> Column:
    """The weight of a section of ranked evidence; 0.4 for an unknown one."""
    from claimloom.functions.text import weight

    return weight(section, config.SECTION_WEIGHTS, config.UNKNOWN_SECTION)


def section_best(evidence: DataFrame) -> DataFrame:
    """``claim_signature``, ``section_weight``: the best section among a claim's evidence; typed sections only."""
    return evidence.where(F.coalesce("section_type", F.lit("")) != "").groupBy("claim_signature").agg(F.max(section_rank(F.col("section_type"))).alias("section_weight"))


def merge_paths(direct: DataFrame, chains: DataFrame) -> DataFrame:
    """Direct paths and chains together, the direct one where a signature occurs in both."""
    rows = direct.withColumn("_o", F.lit(0)).unionByName(chains.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy("path_signature").orderBy("_o")
    return rows.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth", "_o")
