"""Retrieval: BM25, cosine similarity, and stitching of hits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import retrieval_terms


MOST_BROADCAST = 200_000  # query terms, of at most some ten bytes each, that are sent to every executor


def bm25(chunks: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, *, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """(query, key, score) of every chunk that shares a term with a query; Okapi idf, negative ones replaced by ``eps`` times
    the mean idf. Repeated query terms count as often as they occur.

    The corpus is read twice: for the number of chunks with each term, where each chunk is counted under a term of its own
    for their number and mean size, and for the scores. There the terms of the chunks meet those of the queries first, broadcast if they
    are few enough, and only what is left is shuffled, once, by query and chunk.
    """
    each = chunks.select(key, retrieval_terms(text).alias("w"))
    every = F.lit("\x00")
    rows = each.select(F.size("w").alias("size"), F.explode(F.concat(F.array_distinct("w"), F.array(every))).alias("term"))
    counts = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == every, F.col("size"))).alias("sizes"))
    stats = counts.where(F.col("term") == every).select(F.col("df").alias("n"), (F.col("sizes") / F.col("df")).alias("avgdl"))
    raw = counts.where(F.col("term") != every).crossJoin(F.broadcast(stats)).withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))  # stats: one row
    mean = raw.agg(F.avg("idf").alias("mean"))
    asked = queries.select(query_key, F.explode(retrieval_terms(query_text)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("times"))
    few = asked.count() <= MOST_BROADCAST
    idf = raw.join(F.broadcast(asked.select("term").distinct()) if few else asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean))
    wanted = asked.join(idf.select("term", F.when(F.col("idf") < 0, eps * F.col("mean")).otherwise(F.col("idf")).alias("idf"), "avgdl"), "term")
    said = each.select(key, F.size("w").alias("size"), F.explode("w").alias("term")).join(F.broadcast(wanted) if few else wanted, "term")
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("avgdl")))
    tfs = said.repartition(query_key, key).groupBy(query_key, key, "term", "times", "idf", "size", "avgdl").agg(F.count("*").alias("tf"))
    return tfs.groupBy(query_key, key).agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, query_key: str, key: str, score: Column | str, k: int) -> DataFrame:
    """The ``k`` best of each query, ties to the higher key; k = 0 gives none. Adds ``rank`` from 1."""
    w = Window.partitionBy(query_key).orderBy(F.desc(score), F.desc(key))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stitch(hits: DataFrame, query_key: str, key: str, text: str, separator: str = "\n...\n") -> DataFrame:
    """(query, text): a query's few hits in the order of their keys, with a separator where keys are not neighbours."""
    w = Window.partitionBy(query_key).orderBy(key)
    gap = F.col(key) != F.lag(key).over(w) + 1
    piece = F.concat(F.when(F.lag(key).over(w).isNull(), "").when(gap, separator).otherwise(""), F.col(text))
    rows = hits.withColumn("__piece", piece)
    listed = F.array_sort(F.collect_list(F.struct(key, "__piece")))
    return rows.groupBy(query_key).agg(F.array_join(F.transform(listed, lambda x: x["__piece"]), "").alias("text"))


MOST_QUERY_BYTES = 64 << 20  # of the query vectors that are sent to every executor at once


def cosine_top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, block: int = 2_000) -> DataFrame:
    """(query, key, score, rank): exact cosine top-k of a stated query set against all rows.

    The query vectors are counted first and sent to the executors, in as many slices as their size asks for; the
    corpus is scored where it lies, ``block`` rows at a time, each task keeping ``k`` rows a query, and only these are ranked. Null vectors have no row, those without a length have similarity 0.
    """
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).cast("long").alias("id"), F.col(query_vector).cast("array<float>").alias("v"))
    size = asked.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)).alias("n")).first()["n"] * 8
    slices = max(1, -(-size // MOST_QUERY_BYTES))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def matrix(ids, vs) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        m = np.array([np.asarray(v, np.float64) for v in vs])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.asarray(ids, np.int64), m / np.where(norm > 0, norm, 1)

    def scored(part: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == part).collect()  # MOST_QUERY_BYTES, about, at most
        sent = rows.sparkSession.sparkContext.broadcast(matrix([r["id"] for r in own], [r["v"] for r in own]) if own else None)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if sent.value is None or k < 1:
                return
            qi, qm = sent.value
            ids = scores = None
            for pdf in batches:
                for at in range(0, len(pdf), block):
                    di, dm = matrix(pdf["id"].iloc[at : at + block], pdf["v"].iloc[at : at + block])
                    s = np.round(qm @ dm.T, 6)
                    all_ids, all_s = np.broadcast_to(di, s.shape), s
                    if ids is not None:
                        all_ids, all_s = np.concatenate((ids, all_ids), axis=1), np.concatenate((scores, s), axis=1)
                    best = np.lexsort((-all_ids, -all_s), axis=1)[:, :k]  # ties to the higher key
                    ids, scores = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_s, best, axis=1)
            if ids is not None:
                yield pd.DataFrame({query_key: np.repeat(qi, ids.shape[1]), key: ids.ravel(), "score": scores.ravel()})

        return rows.mapInPandas(score, f"`{query_key}` long, `{key}` long, score double")

    return top_k(reduce(DataFrame.unionAll, [scored(i) for i in range(slices)]), query_key, key, "score", k)
