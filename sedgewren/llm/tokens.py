"""Sizes of texts in tokens of a public byte-level BPE; the vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@functools.cache
def encoder(path: str):
    """The tokenizer of a rank file, once for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of each whole text; NULL and '' have 0. The vocabulary is ``path``, else ``spark.sedgewren.vocabulary``, else the default."""
    spark = SparkSession.getActiveSession()
    path = path or (spark.conf.get("spark.sedgewren.vocabulary", VOCABULARY) if spark else VOCABULARY)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
