"""Scores of predictions: fuzzy choice, chrF over a corpus, metric tables and slices."""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

Scorer = Callable[[Column, Column], Column]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


@scorer("exact")
def exact(pred: Column, answer: Column) -> Column:
    return F.coalesce((F.lower(F.trim(pred)) == F.lower(F.trim(answer))).cast("double"), F.lit(0.0))


@scorer("contains")
def contains(pred: Column, answer: Column) -> Column:
    return F.coalesce(F.contains(F.lower(pred), F.lower(answer)).cast("double"), F.lit(0.0))


@F.pandas_udf(ArrayType(DoubleType()))
def fuzzy_ratios(texts: pd.Series, options: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of a text to each option, which no built-in has."""
    return pd.Series([[difflib.SequenceMatcher(None, t or "", o or "").ratio() for o in (opts if opts is not None else [])] for t, opts in zip(texts, options, strict=True)])


def best_option(df: DataFrame, text: str, options: str) -> DataFrame:
    """Adds the place of the option most like the text, the first of equals; null without options."""
    r = df.withColumn("__r", fuzzy_ratios(text, options))
    return r.withColumn("best", F.array_position("__r", F.array_max("__r")).cast("int") - 1).drop("__r")


def chrf(pairs: DataFrame, pred: str, ref: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF, one row: character n-gram counts without blanks are summed over all pairs before they are divided.
    A pair's n-grams are compared in its row; only three sums an order and task are shuffled. Null texts count as empty; without any n-gram the score is 0, without any row null."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {n: [0, 0, 0] for n in range(1, order + 1)}
        for pdf in batches:
            for p, r in zip(pdf["p"], pdf["r"], strict=True):
                for n, t in total.items():
                    a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (p, r))
                    t[0] += sum(min(c, b[g]) for g, c in a.items() if g in b)
                    t[1] += a.total()
                    t[2] += b.total()
        yield pd.DataFrame([(n, *t) for n, t in total.items()], columns=["n", "hit", "pred", "ref"])

    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "")
    each = pairs.select(clean(pred).alias("p"), clean(ref).alias("r")).mapInPandas(sums, "n long, hit long, pred long, ref long")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    orders = each.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("hit", "pred", "ref")])
    per = orders.where((F.col("pred") > 0) | (F.col("ref") > 0)).select(share("hit", "pred").alias("precision"), share("hit", "ref").alias("recall"))
    mean = per.agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    f = (1 + beta**2) * F.col("p") * F.col("r") / (beta**2 * F.col("p") + F.col("r"))
    return mean.select(F.round(100 * F.when(F.col("p") + F.col("r") > 0, f).otherwise(0.0), 6).alias("chrf"))


def score_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("score")]


def mean_scores(df: DataFrame, prefix: str) -> DataFrame:
    """One row: the mean of every column whose name ends in ``score``, its name prefixed."""
    return df.agg(*[F.avg(c).alias(f"{prefix}{c}") for c in score_columns(df)])


def slice_means(df: DataFrame, by: list[list[str]], scores: list[str]) -> DataFrame:
    """Means of the scores for each set of grouping columns, in one scan and one shuffle; rows with a null key are left out of that set.
    ``slice`` names the set, ``keys`` the group."""
    known = lambda cols: reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])
    place = lambda cols: F.struct(F.lit("+".join(cols)).alias("slice"), F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("key"))
    sets = F.array_compact(F.array(*[F.when(known(cols), place(cols)) for cols in by]))
    rows = df.select(F.explode(sets).alias("__at"), *scores)
    return rows.groupBy("__at.slice", "__at.key").agg(F.count("*").alias("n"), *[F.avg(s).alias(s) for s in scores])


def grouping_means(df: DataFrame, sets: list[list[str]], scores: list[str]) -> DataFrame:
    """Number of rows and means of the scores by each set of columns; columns outside a set are null and ``set_id`` tells the sets
    apart as SQL's grouping_id does. Null keys form groups of their own."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    which = F.grouping_id(*cols).alias("set_id")
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(which, F.count("*").alias("n"), *[F.avg(s).alias(s) for s in scores])


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; exact repeats of a key are cut to one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def distinct_rows(parts: list[DataFrame], order: str) -> DataFrame:
    """Union of slices without repeats: of rows equal in all columns but ``order`` the one with the least order."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cols = [c for c in rows.columns if c != order]
    return rows.groupBy(*cols).agg(F.min(order).alias(order))


def generation_table(questions: DataFrame, samples: int, answers: DataFrame, scorers: list[str], key: str) -> DataFrame:
    """Every question with every sample number, its prediction (left join: a failed generation keeps its row), and a
    column ``<scorer>_score`` each."""
    asked = questions.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_idx"))
    rows = asked.join(answers, [key, "sample_idx"], "left")
    for s in scorers:
        rows = rows.withColumn("score" if s == "" else f"{s}_score", SCORERS[s](F.col("pred"), F.col("answer")))
    return rows
