"""Queries on retrieval. The query set is every row whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.text import STOP_WORDS, fixed_chunks
from textloom.operators import retrieval as R
from textloom.plans.catalogue import query
from textloom.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = lambda x: f"list_filter(regexp_extract_all(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}))"
_BM25 = f"""WITH ch AS (SELECT doc_id * 1000 + i AS chunk_id, substr(text, CAST(i * 500 + 1 AS BIGINT), 500) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, (len(text) - 1) // 500 + 1)) AS i) WHERE len(text) > 0),
t AS (SELECT chunk_id, chunk, {_TERMS('chunk')} AS w FROM ch), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT chunk_id, len(w) AS size, term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM t) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, st), idfs AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS('question')}) AS term FROM eval_items WHERE item_id % 20 = 0) GROUP BY ALL),
sc AS (SELECT item_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avgdl))) AS s FROM q JOIN idfs USING (term) JOIN p USING (term), st GROUP BY ALL),
top AS (SELECT item_id, chunk_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, chunk_id DESC) AS INTEGER) AS rank FROM sc)
"""


def _top(spark, folder, k):
    chunks = table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.inline(fixed_chunks("text", 500))).select((F.col("doc_id") * 1000 + F.col("chunk_no")).alias("chunk_id"), "chunk")
    asked = table(spark, folder, "eval_items", "item_id", "question").where("item_id % 20 = 0")
    scores = R.bm25(chunks, "chunk_id", "chunk", asked, "item_id", "question")
    return chunks, R.top_k(scores.withColumn("score", F.round("score", 6)), "item_id", "chunk_id", "score", k)


@query("bm25_topk", _BM25 + "SELECT item_id, chunk_id, score, rank FROM top WHERE rank <= 10")
def bm25_topk(spark, folder):
    return _top(spark, folder, 10)[1]


@query(
    "bm25_stitched",
    _BM25 + """, h AS (SELECT item_id, chunk_id, chunk, lag(chunk_id) OVER (PARTITION BY item_id ORDER BY chunk_id) AS before FROM top JOIN ch USING (chunk_id) WHERE rank <= 4)
    SELECT item_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN chunk_id <> before + 1 THEN chr(10) || '...' || chr(10) ELSE '' END || chunk, '' ORDER BY chunk_id) AS text FROM h GROUP BY item_id""",
)
def bm25_stitched(spark, folder):
    chunks, hits = _top(spark, folder, 4)
    return R.stitch(hits.join(chunks, "chunk_id"), "item_id", "chunk_id", "chunk")


@query("exclude_seen_chunks", _BM25 + "SELECT item_id, chunk_id FROM top JOIN ch USING (chunk_id) WHERE rank <= 10 AND NOT contains((SELECT string_agg(chunk, '' ORDER BY chunk_id) FROM ch WHERE chunk_id < 20000), chunk)")
def exclude_seen_chunks(spark, folder):
    """Hits that a context of the first documents does not hold already. The context is one bounded text."""
    chunks, hits = _top(spark, folder, 10)
    seen = chunks.where("chunk_id < 20000").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "chunk"))), lambda x: x["chunk"]), "").alias("context"))
    return hits.join(chunks, "chunk_id").crossJoin(F.broadcast(seen)).where(~F.contains("context", "chunk")).select("item_id", "chunk_id")


@query(
    "cosine_topk",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings)
    SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
)
def cosine_topk(spark, folder):
    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    return R.cosine_top_k(v, "vec_id", "embedding", asked, "query_id", "qe", 10)
