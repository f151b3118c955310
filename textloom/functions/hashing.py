"""Draws that any SQL engine can repeat: a number in [0, 2**32) from the md5 of a seed and a row's key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 2**32


def draw(seed: str, *parts: Column | str) -> Column:
    """The first 32 bits of md5('seed|part|part...') as a whole number."""
    text = F.concat_ws("|", F.lit(seed), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw_sql(seed: str, *parts: str) -> str:
    """The same in DuckDB's SQL."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def unit(seed: str, *parts: Column | str) -> Column:
    """A draw in [0, 1)."""
    return draw(seed, *parts) / F.lit(float(RANGE))
