"""The vector stage of a build: what has to be embedded, its vectors, and the tables they are kept in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import or_default
from claimloom.lineage import cut
from claimloom.operators import graph
from claimloom.operators.upsert import changed_texts, new_rows
from claimloom.providers import Embedder, embedded
from claimloom.sources.sinks import _exists, current_vectors, write_vectors


def paper_texts(papers: DataFrame) -> DataFrame:
    """``paper_id``, ``text``: a paper's purpose, or its title."""
    return papers.select("paper_id", or_default(F.col("purpose_of_work"), F.coalesce("title", F.lit(""))).alias("text"))


def claim_texts(claims: DataFrame, evidence: DataFrame, papers: DataFrame, most: int = 2) -> DataFrame:
    """``claim_signature``, ``text``: a claim and its ``most`` best pieces of evidence."""
    lists = graph.evidence_lists(evidence, papers, most)
    head = F.concat_ws(" ", "source_name", "relation_type", "target_name")
    return claims.join(lists, "claim_signature", "left").select("claim_signature", F.concat_ws(". ", head, F.array_join(F.col("evidence_list.evidence_text"), ". ")).alias("text"))


def with_vectors(rows: DataFrame, key: str, embedder: Embedder) -> DataFrame:
    """``key``, ``text``, ``embedding`` of rows with a text; rows without one, and those the embedder gave nothing for, have no vector and stay out, so the next run asks again."""
    asked = rows.where(F.coalesce("text", F.lit("")) != "").select(key, "text")
    return asked.withColumn("embedding", embedded("text", embedder)).where("embedding IS NOT NULL")


def backfill(rows: DataFrame, key: str, path: str, embedder: Embedder, again: bool = True) -> dict[str, int]:
    """Embed what the vector table at ``path`` lacks and write it back as a new version: new keys, and, with ``again``, keys whose text has changed.

    Gives the counts: ``seen``, ``embedded``. What is stored and unchanged is not embedded. A run that failed is simply run again.
    """
    spark = rows.sparkSession
    version = 0
    todo = rows
    if _exists(rows, path):
        kept = spark.read.parquet(path)
        version = (kept.agg(F.max("version")).first()[0] or 0) + 1
        stored = current_vectors(kept, key)
        todo = changed_texts(rows, stored.select(key, "text"), key, "text") if again else new_rows(rows, stored, key)
    fresh = cut(with_vectors(todo, key, embedder))
    written = fresh.count()
    if written:
        write_vectors(fresh, path, version)
    return {"seen": rows.count(), "embedded": written}


def collections(table: Callable[[str], DataFrame], embedder: Embedder, path: str) -> dict[str, dict[str, int]]:
    """The four vector collections of a build, ``<name>_vectors.parquet`` under ``path``: chunks, papers, evidence and claims. ``table`` gives the build's tables by name (points, papers, evidence, claims).

    Chunks, papers and evidence are embedded once; claims again when their text changes.
    """
    jobs = {
        "chunks": (table("points").select("point_id", "text"), "point_id", False),
        "papers": (paper_texts(table("papers")), "paper_id", False),
        "evidence": (table("evidence").select("evidence_id", F.col("evidence_text").alias("text")), "evidence_id", False),
        "claims": (claim_texts(table("claims"), table("evidence"), table("papers")), "claim_signature", True),
    }
    return {name: backfill(rows, key, f"{path}/{name}_vectors.parquet", embedder, again) for name, (rows, key, again) in jobs.items()}
