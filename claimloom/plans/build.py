"""The build: registries, graph tables and vector tables from mentions, stage by stage, with a run log.

Each stage reads the tables that earlier ones wrote and writes its own; a stage whose table is complete is skipped, so a build that failed resumes.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions import text as T
from claimloom.operators import graph, registry
from claimloom.plans import embedding
from claimloom.providers import Embedder
from claimloom.sources.sinks import _exists


@dataclass
class Stage:
    """A table of the build: its name, how it is made from the tables so far, and the key that must be unique in it."""

    name: str
    make: Callable[[Callable[[str], DataFrame]], DataFrame]
    key: tuple[str, ...] = ()


def chunk_points(chunks: DataFrame) -> DataFrame:
    """Points of the vector store: the word windows of every section (paper_id, chunk_idx, header, body), references and appendices left out by the reader."""
    rows = chunks.select("paper_id", "chunk_idx", F.col("header").alias("section_name"), T.rich_section(F.col("header")).alias("section_type"), T.windows(F.col("body")).alias("_w"))
    each = rows.select("*", F.posexplode("_w").alias("window_index", "text")).where("text <> ''")
    return each.select((F.col("paper_id").cast("long") * 1000000 + F.col("chunk_idx") * 1000 + F.col("window_index")).alias("point_id"), "paper_id", "section_name", "section_type", "window_index", F.size("_w").alias("window_count"), "text")


def stages(entity_mentions: DataFrame, relation_mentions: DataFrame, papers: DataFrame, chunks: DataFrame) -> list[Stage]:
    """The stages in their order. ``papers`` has a whole number as paper_id; ``chunks`` is what ``sources.files.chunk_files`` gives."""

    def entities(_: Callable) -> DataFrame:
        names = entity_mentions.where(T.stripped(F.coalesce("canonical_name", F.lit(""))) != "").select(T.stripped("canonical_name").alias("name"), "seq")
        first = names.groupBy(F.lower("name").alias("_key")).agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
        leaders = registry.greedy_leaders(first.select("name", "seq"), registry.fuzzy_pairs(first.select("name", "seq"))).select(F.lower("name").alias("_key"), "leader")
        led = entity_mentions.withColumn("_key", F.lower(T.stripped("canonical_name"))).join(leaders, "_key").withColumn("canonical_name", F.col("leader")).drop("_key", "leader")
        return registry.entity_registry(led)

    def resolved(t: Callable) -> DataFrame:
        return registry.resolve_names(relation_mentions.withColumn("source_name", T.stripped("source_name")).withColumn("target_name", T.stripped("target_name")), t("forms"), "source_name", "target_name")

    def weighted(t: Callable) -> DataFrame:
        claims = registry.claim_registry(t("relations"))
        paper_ids = t("relations").where(registry.is_well_formed("source_name", "relation_type", "target_name")).groupBy(F.concat_ws("|", "source_name", "relation_type", "target_name").alias("claim_signature")).agg(F.array_sort(F.collect_set("paper_id")).alias("paper_ids"))
        rows = claims.join(paper_ids, "claim_signature").withColumn("claim_id", F.xxhash64("claim_signature"))
        return registry.paper_weights(rows, papers)

    design = T.or_default(F.col("study_design"), "other")
    return [
        Stage("papers", lambda _: papers.withColumn("study_design", design).withColumn("study_weight", T.weight(design, config.DESIGN_WEIGHTS, config.UNKNOWN_DESIGN)), ("paper_id",)),
        Stage("entities", entities, ("canonical_name",)),
        Stage("forms", lambda t: registry.forms_index(t("entities")), ("form",)),
        Stage("relations", resolved),
        Stage("claims", weighted, ("claim_signature",)),
        Stage("evidence", lambda t: registry.evidence_rows(t("relations")), ("evidence_id",)),
        Stage("target_edges", lambda t: graph.target_edges(t("claims"), t("entities")), ("claim_signature",)),
        Stage("polarity_edges", lambda t: graph.polarity_edges(t("claims"), t("entities")), ("claim_signature", "polarity")),
        Stage("points", lambda _: chunk_points(chunks), ("point_id",)),
    ]


def run(spark: SparkSession, plan: list[Stage], target: str, again: bool = False, embedder: Embedder | None = None) -> list[dict]:
    """Write every stage's table under ``target`` and give the run log: stage, status (built, skipped), seconds, rows.

    With an ``embedder`` the vector collections follow, of which only what is new or changed is embedded; their rows are those embedded. A broken key stops the build after the table is written, and names the stage.
    """
    log = []
    at = lambda name: f"{target}/{name}.parquet"
    read = lambda name: spark.read.parquet(at(name))
    for stage in plan:
        began = time.time()
        if not again and _exists(spark.range(0), f"{at(stage.name)}/_SUCCESS"):
            log.append({"stage": stage.name, "status": "skipped", "seconds": 0.0, "rows": read(stage.name).count()})
            continue
        stage.make(read).write.mode("overwrite").parquet(at(stage.name))
        rows = read(stage.name)
        if stage.key and not graph.duplicate_keys(rows, *stage.key).isEmpty():
            raise ValueError(f"{stage.name}: {stage.key} is not unique")
        log.append({"stage": stage.name, "status": "built", "seconds": time.time() - began, "rows": rows.count()})
    began = time.time()
    for name, counts in (embedding.collections(read, embedder, target) if embedder else {}).items():
        log.append({"stage": f"{name}_vectors", "status": "built" if counts["embedded"] else "skipped", "seconds": time.time() - began, "rows": counts["embedded"]})
        began = time.time()
    return log


def log_rows(spark: SparkSession, log: list[dict]) -> DataFrame:
    """A run log as run metrics for ``evaluation.run_summary``: stage, total_time_s, ram_mb (null: not measured), success."""
    return spark.createDataFrame([(r["stage"], float(r["seconds"]), None, r["status"] in ("built", "skipped")) for r in log], "stage string, total_time_s double, ram_mb long, success boolean")
