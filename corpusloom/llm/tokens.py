"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, path: str = DEFAULT_VOCABULARY, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of ``text``; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def count(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(path)
        for texts in frames:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(out, count(text))
