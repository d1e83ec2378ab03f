"""Query results as prompt text, by array functions: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def said(value: Column, default: str = "?") -> Column:
    """A value as text, with a mark where it is missing."""
    return F.coalesce(value.cast("string"), F.lit(default))


def evidence_lines(evidence: Column, indent: str) -> Column:
    """``- [P1, rct, 2020] [RESULTS] text`` for each item of an evidence list, a line each, with line feeds."""
    line = lambda e: F.concat(F.lit(f"{indent}- [P"), said(e["paper_id"]), F.lit(", "), said(e["study_design"]), F.lit(", "), said(e["paper_year"]), F.lit("] ["), said(e["section_type"]), F.lit("] "), F.trim(e["evidence_text"]), F.lit("\n"))
    return F.coalesce(F.array_join(F.transform(evidence, line), ""), F.lit(""))


def triple(source: Column, relation: Column, target: Column) -> Column:
    """``a -> relation -> b``."""
    return F.concat_ws(" -> ", source, relation, target)


def claim_block(label: Column, source: Column, relation: Column, target: Column, certainty: Column, papers: Column, evidence: Column, indent: str = "") -> Column:
    """A labelled claim with its certainty, papers and evidence."""
    return F.concat(F.lit(indent), label, F.lit(" "), triple(source, relation, target), F.lit(f"\n{indent}     Certainty: "), said(certainty), F.lit(" | Papers: "), said(papers), F.lit("\n"), evidence_lines(evidence, f"{indent}     "))


def direct_blocks(paths: DataFrame) -> DataFrame:
    """Direct paths (rank, claim columns, evidence_list) with ``label`` [G1].. and ``block``."""
    label = F.concat(F.lit("[G"), F.row_number().over(Window.orderBy("rank")), F.lit("]"))
    rows = paths.withColumn("label", label)
    return rows.withColumn("block", F.concat(claim_block(F.col("label"), *(F.col(c) for c in ("source_name", "relation_type", "target_name", "certainty_max", "paper_count", "evidence_list"))), F.lit("\n")))


def chain_blocks(paths: DataFrame, offset: int | Column) -> DataFrame:
    """Chains (rank, c1_*, c2_*, bridge_name) with ``label`` continuing after ``offset`` (a number or a column) direct ones and ``block``; hops are cited [G4.1], [G4.2]."""
    number = F.row_number().over(Window.orderBy("rank")) + offset
    hop = lambda p, i: claim_block(F.concat(F.lit("[G"), F.col("_n"), F.lit(f".{i}]")), *(F.col(f"{p}_{c}") for c in ("source_name", "relation_type", "target_name", "certainty_max", "paper_count", "evidence_list")), indent="     ")
    head = F.concat(F.lit("[G"), F.col("_n"), F.lit("] CHAIN: "), F.concat_ws(" -> ", "c1_source_name", "c1_relation_type", "bridge_name", "c2_relation_type", "c2_target_name"), F.lit("\n     Bridge: "), F.col("bridge_name"), F.lit("\n"))
    return paths.withColumn("_n", number).withColumn("label", F.concat(F.lit("[G"), F.col("_n"), F.lit("]"))).withColumn("block", F.concat(head, hop("c1", 1), hop("c2", 2), F.lit("\n"))).drop("_n")


def passage_blocks(chunks: DataFrame) -> DataFrame:
    """Retrieved chunks (rank, paper_id, section_type, section_name, text) with ``label`` [V1].. and ``block``."""
    label = F.concat(F.lit("[V"), F.col("rank"), F.lit("]"))
    head = F.concat(label, F.lit(" Paper P"), said(F.col("paper_id")), F.lit(" | "), said(F.col("section_type")), F.lit(" | "), said(F.col("section_name"), ""))
    cite = F.concat(F.lit("\n     Cite as: [V"), F.col("rank"), F.lit(" (P"), said(F.col("paper_id")), F.lit(")]\n     "), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n\n"))
    return chunks.withColumn("label", label).withColumn("block", F.concat(head, cite))


def joined_blocks(blocks: DataFrame) -> DataFrame:
    """One row: the blocks in the order of rank, as ``text``. A prompt's blocks are few."""
    return blocks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "").alias("text"))


def prompt(question: str, graph: DataFrame, passages: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """One row, ``prompt``: question, options, evidence (one-row frames with text) and what to answer."""
    ask = f"## QUESTION\n{question}" + ("\n\n## OPTIONS\n" + "\n".join(f"{k}: {v}" for k, v in options.items()) if options else "")
    how = "Choose the one option the evidence supports best and give its letter inside <answer> tags." if options else "Answer from the evidence above and cite it inline by its labels."
    both = graph.select(F.col("text").alias("_g")).join(passages.select(F.col("text").alias("_v")))
    return both.select(F.concat(F.lit(ask + "\n\n## GRAPH EVIDENCE\n"), "_g", F.lit("\n## PASSAGES\n"), "_v", F.lit("\n## ANSWER\n" + how)).alias("prompt"))


def context_line(source: Column, relation: Column, target: Column, paper: Column, year: Column, section: Column, text: Column) -> Column:
    """One evidence as a judge's context."""
    head = F.concat(F.lit("("), said(source), F.lit(") -["), said(relation), F.lit("]-> ("), said(target), F.lit(")\nEvidence (Paper "))
    return F.concat(head, said(paper), F.lit(", "), said(year), F.lit(", "), said(section), F.lit("): "), said(text, ""))


def context_lines(paths: DataFrame) -> DataFrame:
    """Retrieval context for a judge: one row for each evidence of each path's claims. ``paths`` has path_signature, claims (array of structs with evidence_list)."""
    claims = paths.select("path_signature", F.posexplode("claims").alias("claim_no", "c"))
    each = claims.select("path_signature", "claim_no", "c", F.posexplode("c.evidence_list").alias("evidence_no", "e"))
    fields = [F.col(f"c.{f}") for f in ("source_name", "relation_type", "target_name")] + [F.col(f"e.{f}") for f in ("paper_id", "paper_year", "section_type", "evidence_text")]
    return each.select("path_signature", "claim_no", "evidence_no", context_line(*fields).alias("line"))


def chain_text(entities: Column, relations: Column) -> Column:
    """``A --[r]--> B --[s]--> C``."""
    return F.concat(F.element_at(entities, 1), F.array_join(F.zip_with(relations, F.slice(entities, 2, 100), lambda r, e: F.concat(F.lit(" --["), r, F.lit("]--> "), e)), ""))


def vocabulary_lines(terms: DataFrame) -> DataFrame:
    """``entity_type``, ``lines``: the reference list as text, by type: ``- canonical (alias, alias)``."""
    line = F.concat(F.lit("- "), "canonical", F.when(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ("), F.array_join("aliases", ", "), F.lit(")"))).otherwise(""))
    return terms.groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))


def entity_list(entities: Column) -> Column:
    """An array of entities (canonical_name, entity_type) as text, in its order: ``- name (type)``."""
    return F.array_join(F.transform(entities, lambda e: F.concat(F.lit("- "), said(e["canonical_name"]), F.lit(" ("), said(e["entity_type"]), F.lit(")"))), "\n")
