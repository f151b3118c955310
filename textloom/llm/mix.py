"""Problem 8: mix sources to target shares by balanced (cube) sampling.

Each distinct text of a source is wanted the same expected number of times e = goal / supply, at most
``max_repeats``. Its whole part is given to every text; the fraction is drawn by the cube method: a
*flight* moves the inclusion probabilities along the null space of the balancing equations (number of
texts, number of tokens) until they are 0 or 1, so that both totals stay exactly as they are. Flights
run in parallel in blocks of a source; of each block a dozen texts stay undecided, and these fly on among the
undecided of the other blocks, until a dozen a source are left for the *landing*, which takes of
all their outcomes the one nearest to both totals.
"""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import cut_lineage

BLOCK = 20_000  # texts in one flight
KEEP = 12  # texts of a flight that are left for the landing, which weighs 2 ** (KEEP + 2) outcomes
EPS = 1e-9


def flight(sizes: list[float], chance: list[float], rng: random.Random, keep: int = KEEP) -> list[float]:
    """Moves the chances to 0 or 1 without changing sum(chance) or sum(size * chance); at most two stay
    between, and the last ``keep`` are left alone."""
    p = list(chance)
    active: list[int] = []
    for i in range(len(p) - keep):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        while len(active) >= 2:
            move = _null(active, sizes)
            if move is None:
                break
            up = min((1 - p[k]) / u if u > 0 else p[k] / -u for k, u in move if u)
            down = min(p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in move if u)
            step = up if rng.random() * (up + down) < down else -down
            for k, u in move:
                v = p[k] + step * u
                p[k] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
            active = [k for k in active if 0 < p[k] < 1]
            if len(active) < 3:
                # two of unlike size can't move without a third
                if len(active) < 2 or sizes[active[0]] != sizes[active[1]]:
                    break
    return p


def _null(active: list[int], sizes: list[float]) -> list[tuple[int, float]] | None:
    """A direction in which neither the number nor the size changes."""
    for a, b in itertools.combinations(active, 2):
        if sizes[a] == sizes[b]:
            return [(a, 1.0), (b, -1.0)]
    if len(active) < 3:
        return None
    a, b, c = active[:3]
    x, y, z = sizes[a], sizes[b], sizes[c]
    most = max(abs(y - z), abs(z - x), abs(x - y))
    return [(a, (y - z) / most), (b, (z - x) / most), (c, (x - y) / most)]


def landing(sizes: list[float], chance: list[float]) -> list[float]:
    """Decides what a flight left: of all ways the one whose size, then number, is nearest to the expected."""
    open_ = [i for i, p in enumerate(chance) if 0 < p < 1]
    own, p = np.array([sizes[i] for i in open_], float), np.array([chance[i] for i in open_])
    ways = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(ways @ own - own @ p), np.abs(ways.sum(axis=1) - p.sum())
    best = ways[np.lexsort((off[1], off[0]))[0]]
    out = list(chance)
    for i, v in zip(open_, best.tolist(), strict=True):
        out[i] = float(v)
    return out


def goals(supply: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens wanted of each source. supply: (tokens, texts); targets: (share, max_repeats).

    Without ``total`` the total is chosen, among those at which some source is used up, where the shares
    missed for want of text and those missed because texts are whole are together smallest.
    """
    room = {s: supply.get(s, (0, 0))[0] * r for s, (_, r) in targets.items()}
    able = [s for s, (share, _) in targets.items() if share > 0 and room[s] > 0]
    if not able:
        return dict.fromkeys(targets, 0.0)

    def missed(t: float) -> float:
        short = sum(max(0.0, targets[s][0] - room[s] / t) for s in able)
        grain = sum(supply[s][0] / supply[s][1] for s in able) / t
        return short + grain

    if total is None:
        total = min(sorted(room[s] / targets[s][0] for s in able), key=missed)
    return {s: min(targets[s][0] * total, float(room[s])) if s in able else 0.0 for s in targets}


def mix_sources(
    items: DataFrame, id_col: str, text_col: str, source_col: str, size_col: str, targets: dict[str, tuple[float, int]],
    *, total: int | None = None, seed: int = 0, block: int = BLOCK,
) -> DataFrame:
    """(id, source, size, uses): the texts selected, each with how often it is used.

    A text that occurs in several rows, also under several sources, is one text: it belongs to the
    row with the lowest id among the sources wanted. Null or blank texts, sizes of 0 and sources
    without a target are never selected. ``targets`` maps a source to (share, max_repeats).
    """
    spark = items.sparkSession
    want = spark.createDataFrame([(s, float(sh), int(r)) for s, (sh, r) in targets.items() if sh and r], "source string, share double, repeats int")
    rows = items.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"), F.sha2(F.col(text_col), 256).alias("key"))
    texts = (
        rows.where("size > 0").join(F.broadcast(want.select("source")), "source")
        .groupBy("key").agg(F.min(F.struct("id", "source", "size")).alias("t")).select("t.*")
    )
    texts = cut_lineage(texts)
    supply = {r["source"]: (r["tokens"], r["n"]) for r in texts.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")).collect()}  # one row a target
    wanted = goals(supply, targets, total)
    each = {s: min(wanted[s] / supply[s][0], targets[s][1]) for s in supply}
    blocks = {s: max(1, -(-n // block)) for s, (_, n) in supply.items()}
    rates = spark.createDataFrame([(s, int(e), e - int(e), blocks[s]) for s, e in each.items()] or [("", 0, 0.0, 1)], "source string, base int, chance double, blocks int")
    texts = texts.join(F.broadcast(rates), "source").withColumn("turn", F.xxhash64("id", F.lit(seed)))
    texts = texts.withColumn("chance", F.when(F.col("chance") < 1e-9, 0.0).otherwise(F.col("chance"))).withColumn("block", F.pmod("turn", "blocks"))

    schema = "source string, id long, size long, base int, chance double, turn long"

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"])
        rng = random.Random(zlib.crc32(f"{seed}|{pdf['source'].iloc[0]}|{pdf['turn'].iloc[0]}".encode()))
        return pdf[["source", "id", "size", "base", "turn"]].assign(chance=flight(pdf["size"].tolist(), pdf["chance"].tolist(), rng))[schema_columns]

    schema_columns = [c.split()[0] for c in schema.split(", ")]
    rows = texts.groupBy("source", "block").applyInPandas(fly, schema)
    left = max(blocks.values(), default=1)
    while left > 1:  # a dozen of each block are still open; they fly together, in fewer blocks each time
        rows = cut_lineage(rows)
        left = -(-(KEEP + 2) * left // block)
        open_ = rows.where("chance > 0 and chance < 1")
        flown = open_.withColumn("block", F.pmod("turn", F.lit(left))).groupBy("source", "block").applyInPandas(fly, schema)
        rows = rows.where("chance = 0 or chance = 1").unionByName(flown)
    rows = cut_lineage(rows)

    def land(pdf: pd.DataFrame) -> pd.DataFrame:  # at most KEEP + 2 rows a source
        pdf = pdf.sort_values(["turn", "id"])
        return pdf.assign(chance=landing(pdf["size"].tolist(), pdf["chance"].tolist()))[schema_columns]

    landed = rows.where("chance > 0 and chance < 1").groupBy("source").applyInPandas(land, schema)
    done = rows.where("chance = 0 or chance = 1").unionByName(landed)
    return done.select(F.col("id").alias(id_col), "source", "size", (F.col("base") + F.col("chance").cast("int")).alias("uses")).where("uses > 0")


def shares(selection: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, target_share, texts, most_uses, tokens, share): what a selection reached; every target has a row."""
    spark = selection.sparkSession
    want = spark.createDataFrame([(s, float(sh), int(r)) for s, (sh, r) in targets.items()], "source string, target_share double, max_repeats int")
    got = selection.groupBy("source").agg(F.count("*").alias("texts"), F.max("uses").alias("most_uses"), F.sum(F.col("size") * F.col("uses")).alias("tokens"))
    all_ = selection.agg(F.sum(F.col("size") * F.col("uses")).alias("total"))
    return F.broadcast(want).join(got, "source", "left").crossJoin(F.broadcast(all_)).select(
        "source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.round(F.col("tokens") / F.col("total"), 6), F.lit(0.0)).alias("share"),
    )
