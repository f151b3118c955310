"""Streaming forms of date buckets and of packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, ts: str, label: str, width: str, late: str) -> DataFrame:
    """Counts by window and label with a watermark; windows close when ``late`` has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), label).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), label, "n")


def pack_stream(items: DataFrame, shard: str, ord_col: str, length: str, size: int) -> DataFrame:
    """(shard, ord, length, bin): greedy pad-mode packing of an endless stream; the state of a shard is its open bin and how full it is.
    Items are taken in the order of arrival: within a trigger by ord, and triggers one after the other, so a source that sends ord out of order over triggers is packed as it came."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        current, filled = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(ord_col)
        bins = []
        for n in rows[length]:
            if filled and filled + n > size:
                current, filled = current + 1, 0
            bins.append(current)
            filled += int(n)
            if filled > size:
                current, filled = current + 1, 0
        state.update((current, filled))
        yield pd.DataFrame({"shard": [key[0]] * len(bins), "ord": rows[ord_col].to_numpy(), "length": rows[length].to_numpy(), "bin": bins})

    return items.groupBy(shard).applyInPandasWithState(fold, "shard long, ord long, length long, bin long", "bin long, filled long", "append", GroupStateTimeout.NoTimeout)


def metrics_by_step(rows: DataFrame, step: str, metrics: list[str]) -> DataFrame:
    """Mean of each metric and number of rows by training step, updated as rows come; a step is one key, so partial sums are all the state."""
    return rows.groupBy(step).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def known_prefixes(requests: DataFrame, conv: str, ord_col: str, messages: str, keep: str = "1 hour") -> DataFrame:
    """(conv, ord, prefix): how many first messages of a request its conversation has seen before, as an endless stream. The state of a conversation is
    the hashes of the prefixes that it has seen, and is dropped when nothing came for ``keep``."""
    import hashlib

    from pyspark.sql.streaming.state import GroupStateTimeout

    amount, unit = keep.split()
    millis = int(amount) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(ord_col)
        out = []
        for own in rows[messages]:
            h, best, walked = hashlib.sha256(), 0, []
            for n, m in enumerate(own if own is not None else [], 1):
                text = "" if m is None else m
                h.update(f"{len(text)}:{text}".encode())
                walked.append(h.hexdigest())
                if walked[-1] in seen:
                    best = n
            out.append(best)
            seen.update(walked)
        state.update((sorted(seen),))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame({"conv": [key[0]] * len(out), "ord": rows[ord_col].to_numpy(), "prefix": out})

    return requests.groupBy(conv).applyInPandasWithState(fold, "conv long, ord long, prefix int", "seen array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
