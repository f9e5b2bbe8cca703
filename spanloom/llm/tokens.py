"""Sizes of texts in tokens of a public tokenizer, which is read from a file and never trained."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary (rank file) used unless another is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that goes with these byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of each text; null for a null text."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        e = encoding(path)
        return pd.Series([None if t is None else len(e.encode_ordinary(t)) for t in s], dtype="Int64")

    return count(text)


def sized(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens), a document once: a null text has no tokens, rows without a doc_id are left out.

    Where rows of one doc_id differ, the larger size and the smallest source count.
    """
    x = df.select(F.col("doc_id").cast("long").alias("doc_id"), "source", token_count(F.col("text"), path).alias("tokens")).where("doc_id is not null")
    return x.groupBy("doc_id").agg(F.min("source").alias("source"), F.max(F.coalesce("tokens", F.lit(0))).alias("tokens"))
