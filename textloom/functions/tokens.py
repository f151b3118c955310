"""Offline tokens: runs of non-blank characters, with ids from a hash, behind which a real tokenizer may be put."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = 50_000


def split_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def count_tokens(text: Column | str) -> Column:
    """Number of tokens; null counts 0."""
    return F.coalesce(F.size(split_tokens(text)), F.lit(0)).cast("long")


def token_ids(text: Column | str) -> Column:
    return F.transform(split_tokens(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(VOCABULARY)).cast("int"))


#: Control tokens of two chat formats: ids that open a role's message, close it, and follow a closed message.
#: Fixed values of the formats as published with the models.
CONTROL = {
    "qwen": {"user": ([151644, 872, 198], [151645], [198]), "assistant": ([151644, 77091, 198], [151645], [198]), "system": ([151644, 8948, 198], [151645], [198])},
    "llama": {"user": ([128006, 882, 128007, 271], [128009], []), "assistant": ([128006, 78191, 128007, 271], [128009], []), "system": ([128006, 9125, 128007, 271], [128009], [])},
}


def control(family: str, role: Column, part: int) -> Column:
    """Start (0), end (1) or extra (2) tokens of a role in a family; the family's name in any case."""
    out = F.array().cast("array<int>")
    for name, parts in CONTROL[family.lower()].items():
        out = F.when(role == name, F.array(*map(F.lit, parts[part])).cast("array<int>")).otherwise(out)
    return out
