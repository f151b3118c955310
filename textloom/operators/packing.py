"""Order-dependent packing of sequences into fixed-length batches.

Bins depend on all earlier items, yet a shard is not folded by one task: it is cut in blocks of its order, each
block is walked once for every fill of the open bin that may come in, these walks are put one behind the other on the driver, and each block is
packed from the fill that does come in. The result is that of one walk in order. Bins never cross shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("pad", "truncate")


BLOCKS = 64  # that the items are cut in, over all shards


def greedy_bins(lengths: list[int], size: int, mode: str, filled: int = 0) -> list[int]:
    """Bin of each length, taken in order. An item longer than ``size`` has a bin to itself if it meets an empty one.
    An item that overflows the open bin closes it: in mode ``truncate`` it is the bin's last item, in mode
    ``pad`` it is looked at again with an empty bin. ``filled``: how full bin 0 is already."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    bins, current = [], 0
    for n in lengths:
        if mode == "pad" and filled and filled + n > size:
            current, filled = current + 1, 0
        bins.append(current)
        filled += n
        if filled > size:
            current, filled = current + 1, 0
    return bins


def walk_all(lengths: list[int], size: int, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fill from 0 to ``size`` that the open bin may have before: its fill after the lengths, the bins closed, and the items
    put in the bin that is open then."""
    fill, closed, items = np.arange(size + 1), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    at = 0
    while at < len(lengths):
        if at % 16 == 0 and closed.min() > 0 and (fill == fill[0]).all() and (items == items[0]).all():
            break  # from here on all walks are one
        n = lengths[at]
        if mode == "pad":
            over = (fill > 0) & (fill + n > size)
            closed[over] += 1
            fill[over] = items[over] = 0
        fill += n
        items += 1
        over = fill > size
        closed[over] += 1
        fill[over] = items[over] = 0
        at += 1
    if at < len(lengths):
        f, c, k = int(fill[0]), 0, int(items[0])
        for n in lengths[at:]:
            if mode == "pad" and f and f + n > size:
                f, c, k = 0, c + 1, 0
            f, k = f + n, k + 1
            if f > size:
                f, c, k = 0, c + 1, 0
        fill[:], items[:] = f, k
        closed += c
    return fill, closed, items


def pack(items: DataFrame, ord_col: str, length_col: str, size: int, mode: str = "pad", shards: int = 1) -> DataFrame:
    """(shard, ord, length, bin, pos): shard by ord modulo ``shards``. Lengths must not be null; order ties are broken by length.

    Blocks are ranges of ord between quantiles taken once; what reaches the driver is ``size`` + 1 fills a block, of BLOCKS blocks at
    most. With as many shards as blocks, each shard is one block.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    rows = items.select(F.pmod(F.col(ord_col), F.lit(shards)).cast("int").alias("shard"), F.col(ord_col).cast("long").alias("ord"), F.col(length_col).cast("long").alias("length"))
    blocks = max(1, BLOCKS // shards)
    edges = rows.agg(F.percentile_approx("ord", [i / blocks for i in range(1, blocks)], 10_000).alias("e")).first()["e"] if blocks > 1 else None
    edges = sorted(set(edges or []))
    rows = rows.withColumn("block", F.size(F.filter(F.lit(edges).cast("array<bigint>"), lambda e: e < F.col("ord"))) if edges else F.lit(0))
    starts: dict[tuple[int, int], tuple[int, int, int]] = {}
    if edges:
        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            fill, closed, items_ = walk_all(pdf.sort_values(["ord", "length"])["length"].tolist(), size, mode)
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "block": pdf["block"].iloc[:1], "fill": [fill.tolist()], "closed": [closed.tolist()], "items": [items_.tolist()]})

        now: dict[int, tuple[int, int, int]] = {}
        for r in sorted(rows.groupBy("shard", "block").applyInPandas(walk, "shard int, block int, fill array<long>, closed array<long>, items array<long>").collect(), key=lambda r: r["block"]):
            bin_, filled, count = starts[r["shard"], r["block"]] = now.get(r["shard"], (0, 0, 0))
            closed = r["closed"][filled]
            now[r["shard"]] = (bin_ + closed, r["fill"][filled], r["items"][filled] + (0 if closed else count))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "length"])
        first, filled, count = starts.get((int(pdf["shard"].iloc[0]), int(pdf["block"].iloc[0])), (0, 0, 0)) if len(pdf) else (0, 0, 0)
        bins = pd.Series(greedy_bins(pdf["length"].tolist(), size, mode, filled), index=pdf.index, dtype="int64")
        pos = bins.groupby(bins).cumcount() + count * (bins == 0)
        return pdf.assign(bin=bins + first, pos=pos)[["shard", "ord", "length", "bin", "pos"]]

    return rows.groupBy("shard", "block").applyInPandas(fold, "shard int, ord long, length long, bin long, pos long")


def collate(elements: DataFrame, size: int) -> DataFrame:
    """One row a batch out of elements (shard, bin, pos, input_ids, target_idx): input ids, element number and position
    of each place, target places; cut to ``size`` with the targets beyond it dropped, or padded with zeros."""
    before = Window.partitionBy("shard", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = elements.withColumn("base", F.coalesce(F.sum(F.size("input_ids")).over(before), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "base", "input_ids", "target_idx")))
    flat = lambda f: F.flatten(F.transform("parts", f))

    def fixed(col: Column) -> Column:
        return F.slice(F.concat(col, F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size(col), F.lit(0)))), 1, size)

    length = lambda p: F.size(p["input_ids"])
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return rows.groupBy("shard", "bin").agg(parts.alias("parts")).select(
        "shard", "bin",
        fixed(flat(lambda p: p["input_ids"])).alias("input_ids"),
        fixed(flat(lambda p: F.array_repeat(p["pos"].cast("int"), length(p)))).alias("element_ids"),
        fixed(flat(lambda p: up_to(length(p)))).alias("position_ids"),
        F.filter(flat(lambda p: F.transform(p["target_idx"], lambda i: (i + p["base"]).cast("int"))), lambda i: i < size).alias("target_idx"),
    )


def pack_lines(lines: DataFrame, doc_col: str, ord_col: str, length_col: str, size: int, buffer: int = 20) -> DataFrame:
    """(doc, ord, section, of): lines of a document in order, in sections of at most ``size`` tokens. The buffer counts in the
    test of each line but not in the total. A line that can't fit alone is an error."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        sections, current, filled = [], 0, 0
        for n in pdf["length"]:
            if n + buffer > size:
                raise ValueError(f"a line of {n} tokens does not fit in sections of {size}")
            if filled + n + buffer > size:
                current, filled = current + 1, 0
            sections.append(current)
            filled += n
        return pdf.assign(section=sections, of=current + 1)[["doc", "ord", "section", "of"]]

    rows = lines.select(F.col(doc_col).alias("doc"), F.col(ord_col).cast("long").alias("ord"), F.col(length_col).cast("long").alias("length"))
    return rows.groupBy("doc").applyInPandas(fold, "doc long, ord long, section long, of long")
