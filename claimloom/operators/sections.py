"""Structure of documents: headers, ends of sections, numbering, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.text import is_content_section, stripped, words
from claimloom.lineage import cut


def clean_lines(lines: DataFrame) -> DataFrame:
    """Structure lines (paper_id, pos, line) without excluded headers, " | " made ". ", the subtitle of an appendix removed."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\*+\s*", ""), r":+$", ""))
    kept = lines.where(~F.coalesce(F.trim(bare).isin(config.EXCLUDED_HEADERS), F.lit(False)))
    line = F.regexp_replace(F.replace("line", F.lit(" | "), F.lit(". ")), r"(?i)^(\s*\*\s*Appendix\s+[A-Z0-9]+)\s+.+", "$1")
    return kept.withColumn("line", line)


def parse_structure(lines: DataFrame) -> DataFrame:
    """``paper_id``, ``header_no``, ``header``, ``subheaders``: "* x" starts a header, an indented "* x" belongs to the last one, and to none before the first."""
    marked = lines.where(F.ltrim("line").startswith("*"))
    is_header = ~F.col("line").startswith("    ")
    name = F.regexp_replace(F.trim(F.regexp_replace(F.trim("line"), r"^\*+|\*+$", "")), r":+$", "")
    island = F.sum(is_header.cast("int")).over(Window.partitionBy("paper_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = marked.select("paper_id", "pos", name.alias("name"), is_header.alias("_h"), island.alias("header_no")).where("header_no > 0")
    subs = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "name"))))
    return rows.groupBy("paper_id", "header_no").agg(F.max(F.when(F.col("_h"), F.col("name"))).alias("header"), F.transform(subs, lambda s: s["name"]).alias("subheaders"))


def section_ends(headers: DataFrame) -> DataFrame:
    """Headers (paper_id, pos, header) with ``section_no`` and ``next_header``, null at the document's end; sections without content are left out, yet end others."""
    window = Window.partitionBy("paper_id").orderBy("pos")
    rows = headers.withColumn("next_header", F.lead("header").over(window)).where(is_content_section(F.col("header")))
    return rows.withColumn("section_no", F.row_number().over(window))


def batches(rows: DataFrame, *order: str, size: int = config.BATCH, within: str | None = None) -> DataFrame:
    """``rows`` with ``batch``, numbered from 1 in groups of ``size``, over all rows or ``within`` each value of a column.

    An order over all rows is no one task's work: ranges of it are numbered side by side, and the sizes of the ranges before are added.
    """
    in_batch = lambda n: F.ceil(n / F.lit(size)).cast("int")
    if within:
        return rows.withColumn("batch", in_batch(F.row_number().over(Window.partitionBy(within).orderBy(*order))))
    ranges = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))  # one row a range
    numbered = ranges.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(before, "_range").withColumn("batch", in_batch(F.col("_nth") + F.col("_before"))).select(*rows.columns, "batch")


def full_text_fallback(documents: DataFrame, headers: DataFrame) -> DataFrame:
    """Sections (paper_id, section_no, header, next_header), and one section "Full Text" of each document (paper_id) that has no content section."""
    ends = section_ends(headers).select("paper_id", "section_no", "header", "next_header")
    bare = documents.select("paper_id").distinct().join(ends.select("paper_id"), "paper_id", "left_anti")
    return ends.unionByName(bare.select("paper_id", F.lit(1).alias("section_no"), F.lit("Full Text").alias("header"), F.lit(None).cast("string").alias("next_header")))


def section_bodies(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """``paper_id``, ``section_no``, ``header``, ``body``: the text (column text) from a header's line to the next one's; all of it for a header that does not occur and for "Full Text"."""
    rows = sections.join(documents.select("paper_id", "text"), "paper_id")
    at = "instr(concat('\\n', text), concat('\\n', header))"
    rest = F.when(F.expr(at) > 0, F.expr(f"substring(text, {at} + length(header))")).otherwise(F.col("text"))
    end = F.expr("coalesce(instr(_rest, concat('\\n', next_header)), 0)")
    body = F.when(end > 0, F.expr("substring(_rest, 1, instr(_rest, concat('\\n', next_header)) - 1)")).otherwise(F.col("_rest"))
    return rows.withColumn("_rest", rest).select("paper_id", "section_no", "header", stripped(body).alias("body"))


def whole_sections(points: DataFrame) -> DataFrame:
    """``paper_id``, ``chunk_idx``, ``text``: every section's words, put together from its points (paper_id, point_id, text), which an earlier run may have cut into windows.

    What a window repeats of the end of the one before it is left out; where it does not repeat that, all of it stays.
    """
    overlap = config.WINDOW_WORDS - config.STRIDE_WORDS
    rows = points.select("paper_id", F.floor(F.col("point_id") % 1000000 / 1000).alias("chunk_idx"), F.struct("point_id", F.coalesce("text", F.lit("")).alias("text")).alias("_p"))
    sections = rows.groupBy("paper_id", "chunk_idx").agg(F.array_sort(F.collect_list("_p")).alias("_p")).withColumn("_w", F.transform("_p", lambda p: words(p["text"])))
    repeats = lambda a, b: (F.size(a) >= overlap) & (F.slice(a, F.greatest(F.size(a) - overlap + 1, F.lit(1)), overlap) == F.slice(b, 1, overlap))
    later = F.transform("_w", lambda w, i: F.when((i > 0) & repeats(F.get("_w", F.greatest(i - 1, F.lit(0))), w), F.slice(w, overlap + 1, F.size(w))).otherwise(w))
    return sections.select("paper_id", "chunk_idx", F.array_join(F.flatten(later), " ").alias("text"))
