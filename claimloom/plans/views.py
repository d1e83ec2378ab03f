"""The engine's logical tables over the tables of a data directory.

Papers, claims, mentions, chunks and the reference list are there. Two roles are filled by declared stand-ins: relation mentions come from
order lines (three edges a line), and a claim's evidence is what the mentions of its source entity say in the claim's papers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.text import stripped
from claimloom.operators.registry import first_rows, paper_weights
from claimloom.sources.tables import current_rows, table


def _current(spark: SparkSession, d: str, name: str, key: str, time: str, columns: tuple[str, ...]) -> DataFrame:
    """Current rows with the given columns (all without any), so that no other column is read."""
    rows = table(spark, d, name)
    return current_rows(rows.select(*dict.fromkeys((key, time, *columns))) if columns else rows, key, time)


def papers(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current papers, with a whole number as paper_id; with ``columns``, these only, beside it."""
    rows = _current(spark, d, "papers", "paper_id", "ingested_at", columns)
    return rows.withColumn("paper_id", F.expr("try_cast(paper_id AS int)")).where("paper_id IS NOT NULL")


CLAIM_COLUMNS = ("claim_id", "claim_signature", "source_name", "relation_type", "target_name", "polarity_counts", "certainty_max", "paper_ids", "paper_count")


def claims(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Current claims, one for each signature (the highest claim_id), polarity counts as columns n_*. Of vectors and their texts only what is in ``more`` is carried."""
    rows = table(spark, d, "claims").select(*CLAIM_COLUMNS, "embedded_at", F.col("embedding").isNull().alias("_bare"), *more)
    rows = current_rows(rows, "claim_id", "embedded_at", F.col("_bare")).drop("_bare")
    rows = first_rows(rows.where("claim_signature IS NOT NULL"), "claim_signature", F.desc("claim_id"))
    return rows.select("*", *(F.coalesce(F.col("polarity_counts")[p], F.lit(0)).cast("long").alias(f"n_{p}") for p in config.POLARITIES)).drop("polarity_counts", "embedded_at")


def mentions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current entity mentions; ``seq`` is their order."""
    return _current(spark, d, "entity_mentions", "mention_id", "loaded_at", columns).withColumn("seq", F.col("mention_id"))


def evidence(spark: SparkSession, d: str, claim_rows: DataFrame | None = None) -> DataFrame:
    """``claim_signature``, ``evidence_id``, ``evidence_text``, ``paper_id``, ``section_type``."""
    of = (claims(spark, d) if claim_rows is None else claim_rows).select("claim_signature", F.lower("source_name").alias("_name"), F.explode(F.array_distinct("paper_ids")).alias("paper_id"))
    said = mentions(spark, d, "canonical_name", "paper_id", "evidence", "section_type").where(stripped(F.coalesce("evidence", F.lit(""))) != "").select(F.lower("canonical_name").alias("_name"), "paper_id", F.col("mention_id").alias("evidence_id"), stripped("evidence").alias("evidence_text"), "section_type")
    return of.join(said, ["_name", "paper_id"]).drop("_name")


def weighted_claims(spark: SparkSession, d: str, claim_rows: DataFrame | None = None) -> DataFrame:
    """Claims with their study weight."""
    return paper_weights(claims(spark, d) if claim_rows is None else claim_rows, papers(spark, d, "study_design"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """``canonical_name``: the entities of the reference list."""
    return table(spark, d, "canonical_terms").select(F.col("canonical").alias("canonical_name"), "entity_type", "aliases").dropDuplicates(["canonical_name"])


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Current chunks, without their time; with ``columns``, these only, beside point_id."""
    return _current(spark, d, "vector_chunks", "point_id", "loaded_at", columns).drop("loaded_at")


def relation_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Relation mentions of order lines: customer's nation -ordered-> brand -is_a_type_of-> type -supplied_by-> supplier's nation."""
    t = lambda n: table(spark, d, n)
    nation = lambda key, name: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    lines = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    lines = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    lines = lines.join(nation("s_nationkey", "sn"), "s_nationkey").join(nation("c_nationkey", "cn"), "c_nationkey")
    polarity = F.when(F.col("l_quantity") > 45, "uncertain").when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("hypothetical")
    certainty = F.when(F.col("l_discount") < 0.03, "high").when(F.col("l_discount") < 0.07, "moderate").otherwise("low")
    edge = lambda a, at, r, b, bt: F.struct(F.col(a).alias("source_name"), F.lit(at).alias("source_type"), F.lit(r).alias("relation_type"), F.col(b).alias("target_name"), F.lit(bt).alias("target_type"))
    edges = F.array(edge("cn", "nation", "ordered", "p_brand", "brand"), edge("p_brand", "brand", "is_a_type_of", "p_type", "type"), edge("p_type", "type", "supplied_by", "sn", "nation"))
    section = F.element_at(F.array(*(F.lit(s) for s in config.SECTION_WEIGHTS)), F.col("l_linenumber") % 7 + 1)
    text = F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.concat_ws(" ", F.lit("order"), "l_orderkey", F.lit("line"), "l_linenumber"))
    return lines.select(F.col("l_orderkey").alias("paper_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), polarity.alias("polarity"), certainty.alias("certainty"), section.alias("section_type"), text.alias("evidence"), F.inline(edges))
