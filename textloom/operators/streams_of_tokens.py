"""Token streams with control tokens: back to messages, cut to a budget, packed arrays decoded."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType
from pyspark.sql.window import Window


def split_by_headers(tokens: DataFrame, key: str, pos: str, token: str, start: str, header_end: str, end: str) -> DataFrame:
    """(key, message, role, tokens) of a token stream ``start role header_end ... end start ...``. A message is what lies between
    two starts; its role is the token before header_end. Tokens before the first start belong to no message."""
    order = Window.partitionBy(key).orderBy(pos)
    rows = tokens.withColumn("message", F.sum((F.col(token) == start).cast("int")).over(order)).where("message > 0")
    own = Window.partitionBy(key, "message").orderBy(pos)
    rows = rows.withColumn("__body", F.coalesce(F.sum((F.col(token) == header_end).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    role = F.max(F.when((F.col("__body") == 0) & ~F.col(token).isin(start, header_end), F.col(token)))
    body = F.array_sort(F.collect_list(F.when((F.col("__body") > 0) & (F.col(token) != end), F.struct(pos, token))))
    return rows.groupBy(key, "message").agg(role.alias("role"), F.transform(body, lambda x: x[token]).alias("tokens"))


def cut_keeping_end(ids: Column, most: int, end: list[int]) -> Column:
    """At most ``most`` tokens, the last ones always the closing tokens."""
    tail = F.array(*map(F.lit, end))
    return F.when(F.size(ids) <= most, ids).otherwise(F.concat(F.slice(ids, 1, most - len(end)), tail))


def _decode(texts: pd.Series, dtype: str) -> pd.Series:
    return pd.Series([None if t is None else np.frombuffer(base64.b64decode(t), dtype).tolist() for t in texts])


@F.pandas_udf(ArrayType(DoubleType()))
def decode_floats(texts: pd.Series) -> pd.Series:
    """Base64 of little-endian 32-bit floats, which no built-in reads."""
    return _decode(texts, "<f4")


@F.pandas_udf(ArrayType(LongType()))
def decode_ints(texts: pd.Series) -> pd.Series:
    return _decode(texts, "<i4")


def reshape(values: Column, width: int) -> Column:
    """A flat array as rows of ``width``; a rest that is too short is dropped."""
    rows = F.floor(F.size(values) / width).cast("int")
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(values, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<double>>"))


def undo(messages: Column) -> Column:
    """A chat without its last pair; a single message is cleared."""
    return F.when(F.size(messages) >= 2, F.slice(messages, F.lit(1), F.size(messages) - 2)).otherwise(F.slice(messages, 1, 0))


def visible(q: Column, kv: Column, q_seq: Column, kv_seq: Column) -> Column:
    """Whether a place sees another in a packed batch: shared ones (sequence -1) always, else the same sequence's earlier ones."""
    return (kv_seq == -1) | ((q_seq == kv_seq) & (kv <= q))
