"""Tokens as TESTDATA.md defines them, and an optional public tokenizer."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A maximal run of letters, digits and underscores, or of other characters that are not white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]+"


def n_tokens(text: Column | str) -> Column:
    """Tokens of a text, counted in the JVM; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    own.encode_special_tokens = True
    return own


def n_tokens_of(vocabulary: str):
    """A counter by a public tokenizer file (path of a ``tokenizers`` JSON), for use in place of
    :func:`n_tokens`; Arrow batches, one encoder a worker. Null counts as 0."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encoded = _encoder(vocabulary).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e.ids) for e in encoded], dtype="int32")

    return count
