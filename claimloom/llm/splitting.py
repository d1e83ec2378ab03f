"""Cutting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.frequency import WHITE
from claimloom.sources.tables import current_rows

#: The limits of TESTDATA.md, in words, and the least share of a piece before a natural boundary is looked for.
MOST_WORDS, OVERLAP, LEAST_SHARE = 400, 80, 0.5

#: The strength of a cut at the end of a sentence.
SENTENCE = 2

PLAN = "array<struct<start:int,length:int,first_word:int,words:int>>"

# Endings that look like the end of a sentence but are not.
ABBREVIATIONS = {"al.", "approx.", "bzw.", "ca.", "cf.", "dr.", "e.g.", "eq.", "etc.", "fig.", "figs.", "i.e.", "incl.", "mr.", "mrs.", "ms.", "no.", "nr.", "p.", "pp.", "prof.", "ref.", "refs.", "resp.", "sec.", "st.", "tab.", "vs.", "z.", "b.", "d.", "h."}

_word = re.compile(f"[^{WHITE}]+")
_close = re.compile(r"[\"'”’»)\]*_]+$")


def boundary_strengths(text: str, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The strength of a cut before each word but the first: 4 paragraph, 3 line, 2 sentence, 1 clause, 0 any other gap."""
    out = np.zeros(len(starts), dtype=np.int64)
    for i in range(1, len(starts)):
        gap = text[ends[i - 1] : starts[i]]
        if breaks := gap.count("\n") + 2 * gap.count("\u2029") + gap.count("\u2028") or int("\r" in gap):
            out[i] = 4 if breaks > 1 else 3
            continue
        tail = _close.sub("", text[max(starts[i - 1], ends[i - 1] - 16) : ends[i - 1]])
        if tail[-1:] in "。！？" and tail:
            out[i] = 2
        elif tail[-1:] in (".", "!", "?", "…"):
            out[i] = 1 if tail.lower() in ABBREVIATIONS or text[starts[i]].islower() else 2
        elif tail[-1:] in (",", ";", ":", "–", "—"):
            out[i] = 1
    return out


class RangeMaximum:
    """Sparse table over values: the position of the greatest value in a range, the rightmost of equals.

    Only the levels that ranges of at most ``longest`` need are kept, so memory is O(n log longest).
    """

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.levels = [(values.astype(np.int64) << 40) + np.arange(len(values))]
        step = 1
        while 2 * step <= min(longest, len(values)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def query(self, first: int, last: int) -> int:
        """The position for the inclusive range."""
        k = (last - first + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[first], level[last - (1 << k) + 1])) & ((1 << 40) - 1)


def split_plan(text: str | None, most: int = MOST_WORDS, overlap: int = OVERLAP, least: float = LEAST_SHARE) -> list[tuple[int, int, int, int]]:
    """The pieces of one text: start and length in characters, first word, number of words.

    Every piece but the last ends at the strongest boundary that leaves between ``least`` of ``most`` and ``most`` words, the
    rightmost of equals; where that is no end of a sentence, at the strongest that leaves more than ``overlap`` words. The next one starts ``overlap`` words before that end. A text of at most ``most`` words is one
    piece, its whole; null and texts without words give one piece without words (null: none).
    """
    if text is None:
        return []
    if len(text) < 2 * most or len(spans := [m.span() for m in _word.finditer(text)]) <= most:
        return [(0, len(text), 0, len(_word.findall(text)))]
    starts, ends = np.array(spans, dtype=np.int64).T
    n = len(starts)
    strengths = boundary_strengths(text, ends, starts)
    index = RangeMaximum(strengths, most)
    floor = max(overlap + 1, int(most * least))
    pieces, first = [], 0
    while n - first > most:
        cut = index.query(first + floor, first + most)
        if strengths[cut] < SENTENCE:
            cut = index.query(first + overlap + 1, first + most)
        pieces.append((first, cut))
        first = cut - overlap
    pieces.append((first, n))
    return [(int(starts[a]), int(ends[b - 1] - starts[a]), a, b - a) for a, b in pieces]


def plan_column(text: str, most: int = MOST_WORDS, overlap: int = OVERLAP, least: float = LEAST_SHARE) -> Column:
    """``split_plan`` of a text column."""
    if not 0 <= overlap < most or not 0 < least <= 1 or overlap + 1 > most:
        raise ValueError("overlap must be under the limit, least a share of it")

    @F.pandas_udf(PLAN)
    def plans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "length", "first_word", "words")
        for batch in batches:
            yield pd.Series([[dict(zip(names, p)) for p in split_plan(t, most, overlap, least)] for t in batch])

    return plans(text)


def _section(name: Column, file: Column) -> Column:
    """A section's plain name: without numbering, in title case; from the chunk's file name where it is missing."""
    plain = lambda c: F.initcap(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, "_", " ")), r"(?U)\s+", " "), r"^[\d.\s:-]+|[\s.,:;-]+$", "")))
    from_file = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"(?i)\.(md|txt)$", "")
    return F.coalesce(F.nullif(plain(name), F.lit("")), F.nullif(plain(from_file), F.lit("")))


def planned(chunks: DataFrame, most: int = MOST_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """``chunks`` with the column ``plan``: the pieces of each text. Rows with a null point_id are dropped."""
    return chunks.where("point_id IS NOT NULL").withColumn("plan", plan_column("text", most, overlap))


def oversized_points(chunks: DataFrame, most: int = MOST_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """``point_id``, ``pieces``, ``words`` of the points whose current text the splitter cuts.

    Texts are planned where they lie and only the figures are shuffled to find each point's current row. Exact copies plan alike.
    """
    figures = planned(chunks, most, overlap).select("point_id", "loaded_at", F.size("plan").alias("pieces"), F.aggregate("plan", F.lit(0), lambda n, p: F.greatest(n, p["first_word"] + p["words"])).alias("words"))
    return current_rows(figures, "point_id", "loaded_at").where("pieces > 1")


def split_chunks(chunks: DataFrame, most: int = MOST_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Every current point's pieces: ``point_id``, ``paper_id``, ``piece``, ``section_name``, ``section_type``, ``window_index``, ``window_count``, ``first_word``, ``words``, ``text``.

    ``piece`` counts within the point. window_index counts all pieces of a section (paper_id and the chunk number in point_id) from 0 in the order
    of points and pieces, window_count is their number, whatever the input said. section_name is the plain name, from the file name if
    missing, else null. Null texts keep one row with null text and no words. Extra columns are left out.
    """
    columns = ["point_id", "paper_id", "section_name", "section_type", "chunk_filename", "text"]
    same = ["point_id", "_a", "_b"]
    rows = chunks.where("point_id IS NOT NULL").select(*columns, "loaded_at", F.xxhash64(*columns, "loaded_at").alias("_a"), F.xxhash64(F.lit(1), *columns, "loaded_at").alias("_b"))
    # Texts are planned where they lie. Current rows and the numbers of pieces come from plans alone, so texts are shuffled once.
    figures = current_rows(planned(rows, most, overlap).select(*same, "loaded_at", "plan"), "point_id", "loaded_at")
    count = F.greatest(F.size("plan"), F.lit(1))
    by_section = Window.partitionBy(F.floor(F.col("point_id") / 1000))
    numbered = figures.select(*same, "plan", (F.sum(count).over(by_section.orderBy("point_id")) - count).alias("_before"), F.sum(count).over(by_section).cast("int").alias("window_count"))
    # A merge join keeps the texts where the copies are told apart; a broadcast join, found late, would shuffle them again.
    texts = rows.drop("loaded_at").join(numbered.hint("merge"), same)
    once = texts.withColumn("_copy", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))).where("_copy = 1")  # exact copies
    pieces = once.select("*", F.posexplode_outer("plan").alias("piece", "_p")).withColumn("piece", F.coalesce("piece", F.lit(0)))
    text = F.substring(F.col("text"), F.col("_p.start") + 1, F.col("_p.length"))
    return pieces.select(
        "point_id", "paper_id", "piece", _section(F.col("section_name"), F.col("chunk_filename")).alias("section_name"), "section_type", (F.col("_before") + F.col("piece")).cast("int").alias("window_index"), "window_count",
        F.coalesce("_p.first_word", F.lit(0)).alias("first_word"), F.coalesce("_p.words", F.lit(0)).alias("words"), text.alias("text"),
    )
