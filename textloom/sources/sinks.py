"""Sinks: conversations, benchmark samples, previews and metrics."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.hashing import draw


def write_conversations(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Snappy Parquet; the path ends in .parquet."""
    if not path.rstrip("/").endswith(".parquet"):
        raise ValueError("conversations are written to .parquet")
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def publish(df: DataFrame, folder: str, config: dict) -> str:
    """Writes a dataset and a manifest of its configuration, columns and row count beside it; returns the data's path."""
    data = os.path.join(folder, "data.parquet")
    write_conversations(df, data, "overwrite")
    manifest = {"config": config, "columns": df.columns, "rows": df.sparkSession.read.parquet(data).count()}
    with open(os.path.join(folder, "manifest.json"), "w") as f:
        json.dump(manifest, f, sort_keys=True)
    return data


def sample_name(prefix: str, config: dict) -> str:
    """File name with the first eight hex digits of the configuration's sha256."""
    return f"{prefix}-{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]}.json"


def write_sample(samples: list[dict], folder: str, prefix: str, config: dict) -> str:
    """Writes a benchmark's samples with their configuration as JSON, under :func:`sample_name`; returns the path."""
    path = os.path.join(folder, sample_name(prefix, config))
    with open(path, "w") as f:
        json.dump({"config": config, "samples": samples}, f)
    return path


def preview(conversations: DataFrame, key: str, rows: int = 256, turns: int | None = None, seed: str = "preview", metadata: str | None = None) -> DataFrame:
    """At most ``rows`` drawn conversations, each of their messages as a column message_0 and on, up to the longest drawn or ``turns``; ``metadata`` as JSON text."""
    some = conversations.withColumn("__u", draw(seed, key)).orderBy("__u", key).limit(rows)
    turns = turns if turns is not None else some.agg(F.max(F.size("messages")).alias("n")).first()["n"] or 0
    meta = [F.to_json(metadata).alias(metadata)] if metadata else []
    return some.select(key, *meta, *[F.get("messages", i)["content"].alias(f"message_{i}") for i in range(turns)])


def log_metrics(df: DataFrame, path: str, step: int) -> None:
    """Appends a one-row table of metrics to a metrics table, by step."""
    df.withColumn("step", F.lit(step)).write.mode("append").parquet(path)
