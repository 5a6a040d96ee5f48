"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemill.runtime import ship

#: Rank file of a byte-level BPE and the pattern that cuts a text into pieces, both of public tokenizers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the piece pattern published with that vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    tiktoken = importlib.import_module("tiktoken")
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; special tokens' strings are ordinary text; NULL counts 0.

    The vocabulary is loaded once per Python worker.
    """
    ship(SparkSession.active())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
