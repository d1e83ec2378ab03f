"""From final paths and passages to a prompt, and to an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.lineage import cut
from claimloom.operators import graph, render, search
from claimloom.plans import retrieval
from claimloom.providers import Embedder, Provider, completed

CLAIM = ("source_name", "relation_type", "target_name", "certainty_max", "paper_count")


def passages(chunks: DataFrame, query: list[float], k: int = config.TOP_K) -> DataFrame:
    """The ``k`` chunks (point_id, embedding and what is shown of them) nearest to the question's vector, with ``rank``."""
    near = search.nearest_to(chunks, "embedding", query, "point_id", k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "point_id")))


def blocks(final: DataFrame, claims: DataFrame, evidence: DataFrame, papers: DataFrame, most: int = config.EVIDENCE_PER_CLAIM) -> tuple[DataFrame, DataFrame]:
    """The final paths (path_signature, length, rank; a few) as blocks of text: (direct claims, chains numbered after them), with rank, label, block."""
    signatures = F.when(F.col("length") == 1, F.array("path_signature")).otherwise(F.split("path_signature", ">>"))
    asked = final.select(F.explode(signatures).alias("claim_signature")).distinct()
    lists = graph.evidence_lists(evidence.join(asked, "claim_signature", "left_semi"), papers, most)
    known = claims.select("claim_signature", *CLAIM).join(asked, "claim_signature", "left_semi").join(lists, "claim_signature", "left")
    direct = final.where("length = 1").select(F.col("path_signature").alias("claim_signature"), "rank").join(known, "claim_signature")
    chains = final.where("length = 2").select("rank", *(F.get(F.split("path_signature", ">>"), i).alias(f"c{i + 1}_claim_signature") for i in (0, 1)))
    for p in ("c1", "c2"):
        chains = chains.join(known.select(*(F.col(c).alias(f"{p}_{c}") for c in known.columns)), f"{p}_claim_signature")
    count = final.agg(F.count_if(F.col("length") == 1).cast("int").alias("_direct"))
    numbered = chains.withColumn("bridge_name", F.col("c1_target_name")).join(F.broadcast(count))
    return render.direct_blocks(direct).select("rank", "label", "block"), render.chain_blocks(numbered, F.col("_direct")).select("rank", "label", "block")


def answer_prompt(question: str, final: DataFrame, claims: DataFrame, evidence: DataFrame, papers: DataFrame, found: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """One row, ``prompt``: the question with its direct claims, its chains and its passages."""
    direct, chains = (render.joined_blocks(b) for b in blocks(final, claims, evidence, papers))
    text = lambda df, name: df.select(F.coalesce("text", F.lit("")).alias(name))
    both = text(direct, "_d").join(text(chains, "_c")).select(F.concat("_d", "_c").alias("text"))
    return render.prompt(question, both, text(render.joined_blocks(render.passage_blocks(found)), "text"), options)


def ask(question: str, entities: DataFrame, claims: DataFrame, evidence: DataFrame, papers: DataFrame, chunks: DataFrame, embedder: Embedder, provider: Provider | None = None, options: dict[str, str] | None = None, generic: list[str] | None = None) -> DataFrame:
    """From a question to its prompt, and with a ``provider`` to its answer: one row. ``claims`` and ``chunks`` hold vectors of the embedder; the final paths, at most eight, are written once."""
    query = list(embedder.embed([question], "query")[0])
    final = cut(retrieval.ask(question, entities, claims, evidence, query, generic).select("path_signature", "length", "rank"))
    prompts = answer_prompt(question, final, claims, evidence, papers, passages(chunks, query), options)
    return answered(prompts, provider) if provider else prompts


def answered(prompts: DataFrame, provider: Provider) -> DataFrame:
    """``prompts`` with ``response``, and ``answer``: what stands inside <answer> tags, or all of the response without them."""
    rows = prompts.withColumn("response", completed("prompt", provider))
    inside = F.regexp_extract("response", r"(?s)<answer>\s*(.*?)\s*</answer>", 1)
    return rows.withColumn("answer", F.when(inside != "", inside).otherwise(F.trim("response")))
