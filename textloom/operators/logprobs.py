"""Top-k log probabilities, dense (rows of K alternatives) and sparse (the leading alternatives that hold the mass).

Long form: keys, token_idx, rank, token_id, logprob. Everything is a window over one token's few alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MISSING_LOGPROB = -1000.0
MISSING_ID = -1


def flatten_mass(dense: DataFrame, keys: list[str], threshold: float = 0.99) -> DataFrame:
    """Keeps of each token the leading alternatives up to the first at which the summed probability reaches ``threshold``;
    of a token that never reaches it only the first."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    token = Window.partitionBy(*keys, "token_idx")
    running = token.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    p = F.exp("logprob")
    rows = dense.withColumn("__cum", F.sum(p).over(running)).withColumn("__all", F.max("__cum").over(token.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    keep = (F.col("rank") == 0) | ((F.col("__all") >= threshold) & (F.col("__cum") - p < threshold))
    return rows.where(keep).drop("__cum", "__all")


def reconstruct(sparse: DataFrame, keys: list[str], shapes: DataFrame, missing: float = MISSING_LOGPROB) -> DataFrame:
    """Dense rows again: every place of each key's (tokens, k) shape, with the missing ones filled."""
    grid = shapes.select(*keys, F.explode(F.sequence(F.lit(0), F.col("tokens") - 1)).alias("token_idx"), "k").select(*keys, "token_idx", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("rank"))
    on = [*keys, "token_idx", "rank"]
    return grid.join(sparse, on, "left").select(*on, F.coalesce("token_id", F.lit(MISSING_ID)).alias("token_id"), F.coalesce("logprob", F.lit(missing)).alias("logprob"))


def alternatives(sparse: DataFrame, keys: list[str], positions: DataFrame | None = None) -> DataFrame:
    """(keys, token_idx, alternatives): one row a token, its alternatives by descending probability, then id. ``positions``
    (keys, token_idx) has the places of the sequences; those without alternatives come out with an empty list."""
    listed = F.collect_list(F.struct((-F.col("logprob")).alias("cost"), "token_id", "logprob"))
    rows = sparse.groupBy(*keys, "token_idx").agg(F.transform(F.array_sort(listed), lambda a: F.struct(a["token_id"].alias("token_id"), a["logprob"].alias("logprob"))).alias("alternatives"))
    if positions is None:
        return rows
    on = [*keys, "token_idx"]
    return positions.select(*on).join(rows, on, "left").select(*on, F.coalesce("alternatives", F.array().cast("array<struct<token_id:int,logprob:double>>")).alias("alternatives"))


def pad_ragged(rows: Column | str, missing: float = MISSING_LOGPROB) -> Column:
    """Rows of log probabilities of unlike lengths (array<array<double>>) filled up to the longest; null rows are filled whole."""
    c = F.col(rows) if isinstance(rows, str) else rows
    full = F.transform(c, lambda r: F.coalesce(r, F.array().cast("array<double>")))
    longest = F.coalesce(F.array_max(F.transform(full, lambda r: F.size(r))), F.lit(0))
    return F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(missing), longest - F.size(r))))


def padded_ids(padded: Column | str) -> Column:
    """Ids for padded rows whose tokens have none."""
    return F.transform(padded, lambda r: F.array_repeat(F.lit(MISSING_ID), F.size(r)))


def leading_mass(logprobs: Column | str, ids: Column | str, threshold: float = 0.99) -> Column:
    """As :func:`flatten_mass` for one sequence in its row: array<array<double>> and array<array<int>> of the same shape, as
    array<struct<token_idx, token_id, logprob>>. Nothing is exploded or shuffled."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    c = lambda x: F.col(x) if isinstance(x, str) else x
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def kept(row: Column) -> Column:  # how many lead up to the threshold; 1 if it is never reached
        walked = F.aggregate(row, start, lambda s, x: F.struct((s["sum"] + F.exp(x)).alias("sum"), F.when(s["sum"] < threshold, s["n"] + 1).otherwise(s["n"]).alias("n")))
        return F.when(walked["sum"] >= threshold, walked["n"]).otherwise(F.least(F.size(row), F.lit(1)))

    def one(row: Column, i: Column) -> Column:
        own = F.get(c(ids), i)
        return F.transform(F.slice(row, F.lit(1), kept(row)), lambda x, j: F.struct(i.cast("int").alias("token_idx"), F.get(own, j).cast("int").alias("token_id"), x.alias("logprob")))

    return F.flatten(F.transform(c(logprobs), one))


def distillation_loss(targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, ce): cross entropy of the student against the teacher's alternatives, -exp(logprob) * student_logprob."""
    return targets.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(-F.exp("logprob") * F.col("student_logprob")).alias("ce"))


def perplexities(losses: DataFrame) -> DataFrame:
    """Token-weighted and element-wise mean loss and perplexity of (n, ce) rows; rows without targets don't count."""
    micro, macro = F.sum("ce") / F.sum("n"), F.avg(F.when(F.col("n") > 0, F.col("ce") / F.col("n")))
    return losses.agg(micro.alias("micro_loss"), F.exp(micro).alias("micro_perplexity"), macro.alias("macro_loss"), F.exp(macro).alias("macro_perplexity"))
