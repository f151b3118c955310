"""Date buckets of fixed width, and weights that fall with a bucket's age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_name(day: Column, start: str, end: str, days: int) -> Column:
    """Name start_to_end of the bucket a day falls in; buckets are ``days`` wide from ``start`` on, the last one ends at ``end``.
    Days outside have none. Arithmetic only: no join with the buckets."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    k = F.floor(F.datediff(day, first) / days).cast("int")
    lo = F.date_add(first, k * days)
    hi = F.least(F.date_add(lo, days), last)
    fmt = lambda d: F.date_format(d, "yyyy-MM-dd")
    return F.when((day >= first) & (day < last), F.concat(fmt(lo), F.lit("_to_"), fmt(hi)))


def buckets(spark, start: str, end: str, days: int) -> DataFrame:
    """(name, start, end) of every bucket between two days."""
    lo = F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1), F.expr(f"interval {days} days"))).alias("start")
    rows = spark.range(1).select(lo).withColumn("end", F.least(F.date_add("start", days), F.to_date(F.lit(end))))
    return rows.select(F.concat(F.date_format("start", "yyyy-MM-dd"), F.lit("_to_"), F.date_format("end", "yyyy-MM-dd")).alias("name"), "start", "end")


def age_days(name: Column, now: str) -> Column:
    """Days from a bucket's end to ``now``, not below 0; 365 for names without dates."""
    end = F.try_to_date(F.split_part(name, F.lit("_to_"), F.lit(2)), "yyyy-MM-dd")
    return F.when(end.isNotNull(), F.greatest(F.datediff(F.to_date(F.lit(now)), end), F.lit(0))).otherwise(365)


def recency_weight(name: Column, size: Column, now: str, half_life: float) -> Column:
    """exp(-ln 2 * age / half life) * size ** 0.3."""
    return F.exp(-F.ln(F.lit(2.0)) * age_days(name, now) / F.lit(half_life)) * F.pow(size, F.lit(0.3))


def more_recent(a: Column, b: Column) -> Column:
    """Whether bucket ``a`` begins after bucket ``b``, by their names; never with a bucket of all time, null names count as such."""
    start = lambda x: F.split_part(x, F.lit("_to_"), F.lit(1))
    return F.coalesce((a != "all_time") & (b != "all_time") & (start(a) > start(b)), F.lit(False))
