"""Tables and figures of papers, from a provider's responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import response_json
from claimloom.operators.upsert import new_rows
from claimloom.providers import Provider, completed
from claimloom.sources.files import FIGURE, TABLE

KINDS = {"tables": TABLE, "figures": FIGURE}


def parsed_items(response: Column, kind: str) -> Column:
    """The array of tables or figures in a response; an empty one where the response is an empty list or null JSON, null where it does not parse."""
    text = response_json(response)
    return F.when(F.trim(text) == "null", F.array().cast(f"array<{KINDS[kind]}>")).otherwise(F.from_json(text, f"array<{KINDS[kind]}>"))


def items(responses: DataFrame, kind: str) -> DataFrame:
    """``paper_id`` and the fields of each table or figure of the papers' responses (paper_id, response). Responses that do not parse give no row: see ``unparsed``."""
    return responses.select("paper_id", F.explode(parsed_items(F.col("response"), kind)).alias("_i")).select("paper_id", "_i.*")


def unparsed(responses: DataFrame, kind: str) -> DataFrame:
    """The responses to set aside."""
    return responses.where(parsed_items(F.col("response"), kind).isNull())


def extracted(requests: DataFrame, done: DataFrame, kind: str, provider: Provider) -> DataFrame:
    """Tables or figures of the papers (paper_id, request) that are not ``done`` (paper_id) yet."""
    fresh = new_rows(requests, done, "paper_id")
    return items(fresh.withColumn("response", completed("request", provider)), kind)
