"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import sys
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank file of the tokenizer; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str = VOCABULARY, packed: bytes | None = None):  # noqa: ANN201
    """The encoding of a rank file, kept for the life of the Python worker. ``packed`` is the file's content, compressed; without it the file is read."""
    import tiktoken

    kept = sys.__dict__.setdefault("_claimloom_encoders", {})
    if vocabulary not in kept:
        content = zlib.decompress(packed or packed_ranks(vocabulary))
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}
        kept[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[vocabulary]


def packed_ranks(vocabulary: str) -> bytes:
    """The compressed content of a rank file."""
    with open(vocabulary, "rb") as file:
        return zlib.compress(file.read(), 1)


def token_count(text: str, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a text column; null for null, 0 for ''. The rank file is read by the driver and goes to the executors with the job."""
    packed = packed_ranks(vocabulary)

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary, packed)
        for batch in batches:
            yield pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in batch], dtype="Int64")

    return counts(text)
