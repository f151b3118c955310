"""Reproducible sampling: every draw is a hash of a seed and a row's key, so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.hashing import draw, unit


def choose_one(df: DataFrame, group: str, key: str, seed: str, value: str) -> DataFrame:
    """One row's value of each group, each row as likely; ties in the draw go to the lower key."""
    return df.groupBy(group).agg(F.min_by(value, F.struct(draw(seed, key), F.col(key))).alias(value))


def without_replacement(df: DataFrame, key: str, n: int, seed: str, group: str | None = None) -> DataFrame:
    """``n`` rows, or all if there are fewer; by group if one is named. Groups are cut to their n first by a bounded
    aggregate before they are ranked, so a group of any size is fine."""
    rows = df.withColumn("__u", draw(seed, key))
    if group is None:
        return rows.orderBy("__u", key).limit(n).drop("__u")
    w = Window.partitionBy(group).orderBy("__u", key)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__u", "__r")


def with_replacement(options: list[str], draws: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds a drawn option to each row of ``draws``."""
    arr = F.array(*map(F.lit, options))
    return draws.withColumn("choice", F.element_at(arr, (draw(seed, key) % len(options) + 1).cast("int")))


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """All rows in a seeded random order, the key breaking ties."""
    return df.withColumn("__u", draw(seed, key)).orderBy("__u", key).drop("__u")


def epoch_shards(df: DataFrame, key: str, seed: str, epoch: int, world: int, block: int = 1_000_000) -> DataFrame:
    """(key, position, rank): a new order each epoch, dealt out to ``world`` readers in turn.

    Positions are counted in ranges of the draw, so that no task ranks more than a range.
    """
    rows = df.select(key).withColumn("__u", draw(f"{seed}-{epoch}", key))
    ranges = 256
    rows = rows.withColumn("__b", F.floor(F.col("__u") / F.lit(2**32 / ranges)).cast("int"))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    start = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__u", key)) - 1
    out = rows.withColumn("__r", within).join(F.broadcast(start), "__b")  # one row a range
    return out.select(key, (F.col("__start") + F.col("__r")).alias("position")).withColumn("rank", F.pmod("position", F.lit(world)).cast("int"))


def weighted_choice(weights: DataFrame, option: str, weight: str, draws: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds to each row of ``draws`` an option drawn by weight: the option whose share of the cumulated weights, in the order
    of the options' names, holds the draw. ``weights`` has a row an option and must be small (labels, buckets);
    options of null or no weight are never drawn."""
    w = Window.orderBy(option)
    cum = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = weights.where(F.col(weight) > 0).select(option, ((cum - F.col(weight)) / total).alias("__lo"), (cum / total).alias("__hi"))
    table = F.array_sort(F.collect_list(F.struct("__hi", option)))
    one = ranges.agg(table.alias("__table"))
    rows = draws.withColumn("__u", unit(seed, key)).crossJoin(F.broadcast(one))  # one row
    hit = F.filter("__table", lambda t: t["__hi"] > F.col("__u"))
    return rows.withColumn(option, F.coalesce(F.get(hit, 0)[option], F.element_at("__table", -1)[option])).drop("__u", "__table")


def interleave(lists: DataFrame, list_col: str, pos_col: str, seed: str) -> DataFrame:
    """All items of several lists in one random order that keeps each list's own: the draws of a list, sorted, are given to
    its items in order."""
    u = draw(seed, list_col, pos_col)
    own = Window.partitionBy(list_col)
    rows = lists.withColumn("__n", F.row_number().over(own.orderBy(pos_col)))
    draws = lists.select(list_col, u.alias("__u"), F.row_number().over(own.orderBy(u, pos_col)).alias("__n"))
    return rows.join(draws, [list_col, "__n"]).drop("__n").withColumnRenamed("__u", "priority")
