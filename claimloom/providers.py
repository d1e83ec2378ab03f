"""The boundary to services that the engine does not reimplement: language models, embeddings, judges.

A provider turns a batch of requests into a batch of responses. ``apply`` runs one over a DataFrame in Arrow batches, with retries.
The defaults work offline: recorded responses, and deterministic vectors that hash a text's words.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Provider(Protocol):
    """A service; ``complete`` gives one response, or None, for each request."""

    def complete(self, requests: Sequence[str]) -> Sequence[str | None]:
        """Responses in the order of the requests."""


class Embedder(Protocol):
    """A service that embeds texts; ``task`` tells it whether they are stored (document) or asked (query)."""

    def embed(self, texts: Sequence[str], task: str = "document") -> Sequence[Sequence[float] | None]:
        """Vectors in the order of the texts."""


class Judge(Protocol):
    """A service that scores answers."""

    def score(self, metric: str, cases: Sequence[dict]) -> Sequence[float | None]:
        """Scores of cases (question, answer, expected, context) in their order, 0 to 1."""


class HashedWords:
    """Vectors of signed word hashes, of length 1: similar word sets give similar vectors. No model; for tests and offline runs."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str], task: str = "document") -> list[list[float]]:
        """One vector a text, the same for either task; a text without words gets zeros."""
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def with_retries(call: Callable, batch: Sequence, tries: int = 3, wait: float = 10.0) -> Sequence:
    """``call(batch)``, again after ``wait`` x n seconds where it fails; the last failure is raised."""
    for n in range(1, tries + 1):
        try:
            return call(batch)
        except Exception:
            if n == tries:
                raise
            time.sleep(wait * n)
    raise AssertionError


def _aligned(batch: pd.Series, asked: pd.Series, answers: Sequence) -> pd.Series:
    """Answers at the places of what was asked, None elsewhere."""
    known = dict(zip(asked.index, answers))
    return pd.Series([known.get(i) for i in batch.index], index=batch.index, dtype=object)


def completed(column: str, provider: Provider, tries: int = 3, wait: float = 10.0) -> Column:
    """A provider's responses to a column of requests; null requests are not sent."""

    @F.pandas_udf(T.StringType())
    def responses(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            asked = batch.dropna()
            said = with_retries(provider.complete, list(asked), tries, wait) if len(asked) else []
            yield _aligned(batch, asked, said)

    return responses(column)


def embedded(column: str, embedder: Embedder, tries: int = 3, wait: float = 5.0, task: str = "document") -> Column:
    """An embedder's vectors for a column of texts; null texts give null. ``task`` is document or query."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            asked = batch.dropna()
            made = with_retries(lambda x: embedder.embed(x, task), list(asked), tries, wait) if len(asked) else []
            yield _aligned(batch, asked, made)

    return vectors(column)


def replayed(requests: DataFrame, recorded: DataFrame, on: str) -> DataFrame:
    """Requests with the recorded response (columns ``on``, response); null where none is recorded."""
    return requests.join(recorded.select(on, "response"), on, "left")


def corrected(rows: DataFrame, first: str, second: str) -> Column:
    """The response of a correcting pass, or the first pass's where the second gave nothing."""
    return F.coalesce(F.nullif(rows[second], F.lit("")), rows[first])


@dataclass(frozen=True)
class Models:
    """A dispatch table: the provider and model name behind each tag."""

    table: dict[str, tuple[str, Provider]]

    def name(self, tag: str) -> str:
        """The model's name."""
        return self._entry(tag)[0]

    def provider(self, tag: str) -> Provider:
        """The provider."""
        return self._entry(tag)[1]

    def _entry(self, tag: str) -> tuple[str, Provider]:
        if tag not in self.table:
            raise KeyError(f"unknown model {tag!r}; known are {sorted(self.table)}")
        return self.table[tag]


def completed_by_tag(rows: DataFrame, request: str, tag: str, models: Models, out: str = "response") -> DataFrame:
    """``rows`` with the response of the model that each row's ``tag`` names; null for an unknown tag. Each row goes to one provider only."""
    response = F.lit(None).cast("string")
    for name in models.table:
        mine = F.when(F.col(tag) == name, F.col(request))
        rows = rows.withColumn(f"_{name}", mine)
        response = F.when(F.col(tag) == name, completed(f"_{name}", models.provider(name))).otherwise(response)
    return rows.withColumn(out, response).drop(*(f"_{name}" for name in models.table))


def completed_or_alternate(rows: DataFrame, request: str, alternate: str, provider: Provider, out: str = "response") -> DataFrame:
    """``rows`` with a provider's response, and where it refused (null or '') the response to the ``alternate`` request, once."""
    first = rows.withColumn("_first", completed(request, provider))
    again = first.withColumn("_again", F.when(F.coalesce("_first", F.lit("")) == "", F.col(alternate)))
    return again.withColumn(out, F.coalesce(F.nullif("_first", F.lit("")), completed("_again", provider))).drop("_first", "_again")


def first_pages(pdfs: DataFrame, reader: Callable[[bytes], str | None]) -> DataFrame:
    """``stem``, ``first_page`` of PDFs (stem, content): what ``reader`` makes of each file's bytes; null where it fails or gives nothing but white space."""

    @F.pandas_udf(T.StringType())
    def pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for content in batch:
                try:
                    text = reader(content)
                except Exception:
                    text = None
                out.append(text if text and text.strip() else None)
            yield pd.Series(out, dtype=object)

    return pdfs.select("stem", pages("content").alias("first_page"))


class SharedWords:
    """Scores from the words that texts share, without a model; for tests and offline runs.

    Relevancy: the question's words in the answer; faithfulness: the answer's words in the context; precision: the context's words that are expected; recall: the expected
    words in the context; context relevancy: the question's words in the context. Each is a share of distinct lower-case words; null where there are none, or where a context is needed and missing.
    """

    PAIRS = {"AnswerRelevancyMetric": ("question", "answer"), "FaithfulnessMetric": ("answer", "context"), "ContextualPrecisionMetric": ("context", "expected"), "ContextualRecallMetric": ("expected", "context"), "ContextualRelevancyMetric": ("question", "context")}

    def score(self, metric: str, cases: Sequence[dict]) -> list[float | None]:
        """A score a case."""
        own, other = self.PAIRS[metric]
        out = []
        for case in cases:
            if case[own] is None or case[other] is None:
                out.append(None)
                continue
            a, b = set(case[own].lower().split()), set(case[other].lower().split())
            out.append(len(a & b) / len(a) if a else None)
        return out


def judged_scores(cases: DataFrame, key: str, judge: Judge, metrics: Sequence[str], threshold: float = 0.7, tries: int = 3, wait: float = 10.0) -> DataFrame:
    """``key``, ``metric``, ``score``, ``success`` (score of at least ``threshold``; null without a score) of cases (question, answer, expected, context strings; context null without retrieval).

    A judge that fails on a batch is asked case by case, so one bad case has no score and the others have theirs.
    """
    fields = ["question", "answer", "expected", "context"]

    def one_by_one(metric: str, batch: list[dict]) -> list[float | None]:
        try:
            return list(with_retries(lambda x: judge.score(metric, x), batch, tries, wait))
        except Exception:
            if len(batch) == 1:
                return [None]
            return [s for case in batch for s in one_by_one(metric, [case])]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = [dict(zip(fields, (None if pd.isna(v) else v for v in row))) for row in zip(*batch)]
            yield pd.Series(list(map(list, zip(*(one_by_one(m, rows) for m in metrics)))), dtype=object) if rows else pd.Series([], dtype=object)

    names = F.array(*(F.lit(m) for m in metrics))
    each = cases.withColumn("_s", scores(*fields)).select(key, F.explode(F.arrays_zip(names.alias("metric"), F.col("_s").alias("score"))).alias("_x")).select(key, "_x.*")
    return each.withColumn("success", F.col("score") >= threshold)
