"""Arithmetic of training runs: learning rates by step, and cache sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _warm(step: Column, peak: float, warmup: int, after: Column) -> Column:
    return F.when(step < warmup, F.lit(peak) * step / F.lit(warmup)).otherwise(after) if warmup else after


def cosine_rate(step: Column, peak: float, warmup: int, total: int, floor: float = 0.0) -> Column:
    """Linear warm-up to ``peak``, then half a cosine down to ``floor`` at ``total``."""
    part = F.least((step - warmup) / F.lit(total - warmup), F.lit(1.0))
    return _warm(step, peak, warmup, F.lit(floor) + 0.5 * (peak - floor) * (1 + F.cos(F.pi() * part)))


def linear_rate(step: Column, peak: float, warmup: int, total: int, floor: float = 0.0) -> Column:
    """Linear warm-up to ``peak``, then linear decay, not below ``floor``."""
    return _warm(step, peak, warmup, F.greatest(F.lit(peak) * (1 - (step - warmup) / F.lit(total - warmup)), F.lit(floor)))


def kv_bytes(layers: int, heads: int, width: int, tokens: Column, bytes_each: int = 2) -> Column:
    """Keys and values of every layer and head for so many tokens."""
    return F.lit(layers * heads * width * 2 * bytes_each).cast("long") * tokens
