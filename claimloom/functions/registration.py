"""The engine's functions for SQL users: scalar SQL functions and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claimloom import config
from claimloom.functions.similarity import composite_score, ratio_score, sorted_score

SCALARS = {
    "word_count": "(t STRING) RETURNS INT RETURN size(filter(split(t, '(?U)\\\\s+'), w -> w <> ''))",
    "cosine": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))",
    "claim_signature": "(s STRING, r STRING, t STRING) RETURNS STRING RETURN concat_ws('|', s, r, t)",
}


@F.udtf(returnType="window_index int, first_word int, text string")
class WordWindows:
    """word_windows(text, size, stride): the sliding word windows of a text."""

    def eval(self, text: str, size: int, stride: int):  # noqa: ANN201, D102
        words = (text or "").split()
        start = index = 0
        while True:
            yield index, start, " ".join(words[start : start + size])
            if start + size >= len(words):
                return
            start, index = start + stride, index + 1


@F.udtf(returnType="n int, at int, span string")
class TokenSpans:
    """token_spans(text, longest): the token n-grams of a text, short ones first."""

    def eval(self, text: str, longest: int):  # noqa: ANN201, D102
        import re

        found = re.findall(r"[A-Za-z0-9']+", text or "")
        for n in range(1, longest + 1):
            for i in range(len(found) - n + 1):
                yield n, i + 1, " ".join(found[i : i + n])


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, function in (("name_ratio", ratio_score), ("name_sorted_ratio", sorted_score), ("name_score", composite_score)):
        spark.udf.register(name, function)
    spark.udtf.register("word_windows", WordWindows)
    spark.udtf.register("token_spans", TokenSpans)
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW section_weights AS SELECT * FROM VALUES " + ", ".join(f"('{k}', {v}D)" for k, v in config.SECTION_WEIGHTS.items()) + " AS t(section_type, weight)")
