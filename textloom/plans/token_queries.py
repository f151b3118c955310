"""Queries on packing and log probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.tokens import count_tokens
from textloom.operators import conversations as C
from textloom.operators import logprobs as L
from textloom.operators import packing as P
from textloom.plans.catalogue import query
from textloom.sources.tables import table

_LEN = """WITH RECURSIVE item AS (SELECT response_id AS ord, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS length, row_number() OVER (ORDER BY response_id) AS i FROM baseline_responses),
"""
_SIZE = 256


def _lengths(spark, folder):
    return table(spark, folder, "baseline_responses", "response_id", "text").select(F.col("response_id").alias("ord"), count_tokens("text").alias("length"))


@query(
    "pack_pad",
    _LEN + f"""fold AS (
      SELECT i, ord, length, CAST(0 AS BIGINT) AS bin, length AS filled FROM item WHERE i = 1
      UNION ALL
      SELECT t.i, t.ord, t.length, CASE WHEN f.filled > {_SIZE} OR (f.filled > 0 AND f.filled + t.length > {_SIZE}) THEN f.bin + 1 ELSE f.bin END,
             CASE WHEN f.filled > {_SIZE} OR (f.filled > 0 AND f.filled + t.length > {_SIZE}) THEN t.length ELSE f.filled + t.length END
      FROM fold f JOIN item t ON t.i = f.i + 1)
    SELECT ord, length, bin FROM fold""",
)
def pack_pad(spark, folder):
    return P.pack(_lengths(spark, folder), "ord", "length", _SIZE, "pad").select("ord", "length", "bin")


@query(
    "pack_truncate",
    _LEN + f"""fold AS (
      SELECT i, ord, length, CAST(0 AS BIGINT) AS bin, length AS filled FROM item WHERE i = 1
      UNION ALL
      SELECT t.i, t.ord, t.length, CASE WHEN f.filled > {_SIZE} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.filled > {_SIZE} THEN t.length ELSE f.filled + t.length END
      FROM fold f JOIN item t ON t.i = f.i + 1)
    SELECT ord, length, bin FROM fold""",
)
def pack_truncate(spark, folder):
    return P.pack(_lengths(spark, folder), "ord", "length", _SIZE, "truncate").select("ord", "length", "bin")


@query(
    "pack_sharded_bins",
    f"""WITH RECURSIVE item AS (SELECT CAST(response_id % 8 AS INTEGER) AS shard, response_id AS ord, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS length, row_number() OVER (PARTITION BY response_id % 8 ORDER BY response_id) AS i FROM baseline_responses),
    fold AS (
      SELECT shard, i, length, CAST(0 AS BIGINT) AS bin, length AS filled FROM item WHERE i = 1
      UNION ALL
      SELECT t.shard, t.i, t.length, CASE WHEN f.filled > {_SIZE} OR (f.filled > 0 AND f.filled + t.length > {_SIZE}) THEN f.bin + 1 ELSE f.bin END,
             CASE WHEN f.filled > {_SIZE} OR (f.filled > 0 AND f.filled + t.length > {_SIZE}) THEN t.length ELSE f.filled + t.length END
      FROM fold f JOIN item t ON t.i = f.i + 1 AND t.shard = f.shard)
    SELECT shard, bin, count(*) AS items, CAST(sum(length) AS BIGINT) AS tokens FROM fold GROUP BY shard, bin""",
)
def pack_sharded_bins(spark, folder):
    """Tokens of each bin with the items in eight shards: none above the size unless it is one item."""
    rows = P.pack(_lengths(spark, folder), "ord", "length", _SIZE, "pad", shards=8)
    return rows.groupBy("shard", "bin").agg(F.count("*").alias("items"), F.sum("length").alias("tokens"))


@query("pack_collate")
def pack_collate(spark, folder):
    """Packed batches of retokenised conversations: sums that show every id, position and target in its place."""
    elements = C.to_element(C.from_responses(table(spark, folder, "baseline_responses", "response_id", "prompt_messages", "text")), "qwen")
    bins = P.pack(elements.select("conv_id", F.size("input_ids").alias("n")), "conv_id", "n", 512, shards=4)
    rows = elements.join(bins, elements["conv_id"] == bins["ord"]).select("shard", "bin", "pos", "input_ids", "target_idx")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x)
    return P.collate(rows, 512).select("shard", "bin", F.size("input_ids").alias("n"), total("input_ids").alias("ids"), total("position_ids").alias("positions"), total("element_ids").alias("elements"), F.size("target_idx").alias("targets"))


@query(
    "section_pack",
    """WITH RECURSIVE s AS (SELECT row_id, k - 1 AS s, sections[k] AS x FROM papers, LATERAL (SELECT unnest(range(1, len(sections) + 1)) AS k) WHERE sections[k] IS NOT NULL), l AS (SELECT row_id, s * 10000 + j - 1 AS ord, len(regexp_extract_all(x.paragraphs[j], '\\S+')) AS n FROM s, LATERAL (SELECT unnest(range(1, len(x.paragraphs) + 1)) AS j) WHERE x.paragraphs[j] IS NOT NULL),
    item AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ord) AS i FROM l),
    fold AS (SELECT row_id, i, ord, CAST(0 AS BIGINT) AS section, n AS filled FROM item WHERE i = 1 UNION ALL
      SELECT t.row_id, t.i, t.ord, CASE WHEN f.filled + t.n + 20 > 4000 THEN f.section + 1 ELSE f.section END, CASE WHEN f.filled + t.n + 20 > 4000 THEN t.n ELSE f.filled + t.n END FROM fold f JOIN item t ON t.row_id = f.row_id AND t.i = f.i + 1)
    SELECT row_id AS doc, CAST(ord AS BIGINT) AS ord, section, max(section) OVER (PARTITION BY row_id) + 1 AS "of" FROM fold""",
)
def section_pack(spark, folder):
    """Lines of the sections' paragraphs in sections of at most 4,000 tokens, numbered i of n."""
    rows = table(spark, folder, "papers", "row_id", "sections").select("row_id", F.posexplode("sections").alias("s", "x")).where("x is not null").select("row_id", "s", F.posexplode("x.paragraphs").alias("p", "text"))
    lines = rows.where("text is not null").select("row_id", (F.col("s") * 10000 + F.col("p")).alias("ord"), count_tokens("text").alias("n"))
    return P.pack_lines(lines, "row_id", "ord", "n", 4000)


# Synthetic log probabilities: the embedding's values in groups of five, the last one of four, are logits, of which one more, lost, takes its share.
_K = 5
_DENSE = f"""WITH v AS (SELECT vec_id, i - 1 AS j, CAST(embedding[i] AS DOUBLE) * 3 AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)),
z AS (SELECT vec_id, j // {_K} AS token_idx, x, j, ln(sum(exp(x)) OVER (PARTITION BY vec_id, j // {_K}) + CASE WHEN (j // {_K}) % 3 = 0 THEN 1.0 ELSE 0.001 END) AS norm FROM v),
d AS (SELECT vec_id, CAST(token_idx AS INTEGER) AS token_idx, CAST(row_number() OVER (PARTITION BY vec_id, token_idx ORDER BY x DESC, j) - 1 AS INTEGER) AS rank, CAST(j AS INTEGER) AS token_id, x - norm AS logprob FROM z),
f AS (SELECT *, sum(exp(logprob)) OVER (PARTITION BY vec_id, token_idx ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum, sum(exp(logprob)) OVER (PARTITION BY vec_id, token_idx) AS mass FROM d),
s AS (SELECT vec_id, token_idx, rank, token_id, logprob FROM f WHERE rank = 0 OR (mass >= 0.9 AND cum - exp(logprob) < 0.9))
"""


def _dense(spark, folder):
    from pyspark.sql.window import Window

    v = table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("j", "e"))
    v = v.select("vec_id", "j", F.floor(F.col("j") / _K).cast("int").alias("token_idx"), (F.col("e").cast("double") * 3).alias("x"))
    token = Window.partitionBy("vec_id", "token_idx")
    lost = F.when(F.col("token_idx") % 3 == 0, 1.0).otherwise(0.001)
    v = v.withColumn("norm", F.ln(F.sum(F.exp("x")).over(token) + lost))
    rank = F.row_number().over(token.orderBy(F.desc("x"), "j")) - 1
    return v.select("vec_id", "token_idx", rank.alias("rank"), F.col("j").alias("token_id"), (F.col("x") - F.col("norm")).alias("logprob"))


@query("logprob_flatten", _DENSE + "SELECT vec_id, token_idx, rank, token_id, round(logprob, 6) AS logprob FROM s")
def logprob_flatten(spark, folder):
    return L.flatten_mass(_dense(spark, folder), ["vec_id"], 0.9).withColumn("logprob", F.round("logprob", 6))


@query(
    "logprob_reconstruct",
    _DENSE + f"""SELECT g.vec_id, CAST(g.token_idx AS INTEGER) AS token_idx, CAST(g.rank AS INTEGER) AS rank, coalesce(s.token_id, -1) AS token_id, round(coalesce(s.logprob, -1000.0), 6) AS logprob
    FROM (SELECT vec_id, t AS token_idx, r AS rank FROM embeddings, LATERAL (SELECT unnest(range(0, 13)) AS t), LATERAL (SELECT unnest(range(0, {_K})) AS r)) g LEFT JOIN s USING (vec_id, token_idx, rank)""",
)
def logprob_reconstruct(spark, folder):
    shapes = table(spark, folder, "embeddings", "vec_id").select("vec_id", F.lit(13).alias("tokens"), F.lit(_K).alias("k"))
    return L.reconstruct(L.flatten_mass(_dense(spark, folder), ["vec_id"], 0.9), ["vec_id"], shapes).withColumn("logprob", F.round("logprob", 6))


@query("logprob_alternatives", _DENSE + "SELECT vec_id, token_idx, count(*) AS n, string_agg(token_id, ',' ORDER BY logprob DESC, token_id) AS ids, round(exp(max(logprob)), 6) AS top_probability FROM s GROUP BY vec_id, token_idx")
def logprob_alternatives(spark, folder):
    rows = L.alternatives(L.flatten_mass(_dense(spark, folder), ["vec_id"], 0.9), ["vec_id"])
    ids = F.array_join(F.transform("alternatives", lambda a: a["token_id"].cast("string")), ",")
    return rows.select("vec_id", "token_idx", F.size("alternatives").cast("long").alias("n"), ids.alias("ids"), F.round(F.exp(F.get("alternatives", 0)["logprob"]), 6).alias("top_probability"))


@query("logprob_in_row", _DENSE + "SELECT vec_id, count(*) AS n, CAST(sum(token_id) AS BIGINT) AS ids, round(sum(logprob), 5) AS total FROM s GROUP BY vec_id")
def logprob_in_row(spark, folder):
    """The same leading alternatives, kept in one expression a sequence: nothing is exploded or shuffled after the rows are made."""
    from pyspark.sql.window import Window  # noqa: F401

    dense = _dense(spark, folder).groupBy("vec_id", "token_idx").agg(F.array_sort(F.collect_list(F.struct("rank", "token_id", "logprob"))).alias("a"))
    rows = dense.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("token_idx", "a"))).alias("t"))
    each = lambda f: F.transform("t", lambda x: F.transform(x["a"], lambda a: a[f]))
    kept = L.leading_mass(F.col("lp"), F.col("ids"), 0.9)
    rows = rows.select("vec_id", each("logprob").alias("lp"), each("token_id").alias("ids")).select("vec_id", kept.alias("k"))
    total = lambda f, zero: F.aggregate("k", F.lit(zero), lambda s, x: s + x[f])
    return rows.select("vec_id", F.size("k").cast("long").alias("n"), F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s + x["token_id"]).alias("ids"), F.round(total("logprob", 0.0), 5).alias("total"))


@query(
    "logprob_pad",
    """WITH v AS (SELECT vec_id, i - 1 AS j, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)), g AS (SELECT vec_id, j // 10 AS t, count(*) AS n, sum(x) AS x FROM v WHERE j % 10 <= vec_id % 7 + (j // 10) % 3 GROUP BY ALL)
    SELECT vec_id, count(*) AS tokens, max(n) AS k, round(sum(x) - 1000.0 * sum(m - n), 4) AS total, CAST(-sum(m) AS BIGINT) AS ids FROM (SELECT *, max(n) OVER (PARTITION BY vec_id) AS m FROM g) GROUP BY vec_id""",
)
def logprob_pad(spark, folder):
    """Ragged rows of values filled up to the longest, with ids that stand for none."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding").withColumn("v", F.col("embedding").cast("array<double>"))
    width = lambda t: F.least(F.pmod("vec_id", F.lit(7)) + t % 3 + 1, F.lit(10), F.size("v") - t * 10).cast("int")
    tokens = F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 10).cast("int"))
    rows = e.select("vec_id", F.transform(tokens, lambda t: F.slice("v", t * 10 + 1, width(t))).alias("rows")).select("vec_id", L.pad_ragged("rows").alias("p")).withColumn("i", L.padded_ids("p"))
    flat = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("double"), lambda s, x: s + x)
    return rows.select("vec_id", F.size("p").cast("long").alias("tokens"), F.size(F.get("p", 0)).cast("long").alias("k"), F.round(flat("p"), 4).alias("total"), flat("i").cast("long").alias("ids"))


_STUDENT = _DENSE + ", t AS (SELECT vec_id, logprob, logprob - (token_id % 7) / 10.0 AS student_logprob FROM s), e AS (SELECT vec_id, count(*) AS n, sum(-exp(logprob) * student_logprob) AS ce FROM t GROUP BY vec_id)\n"


def _student(spark, folder):
    return L.flatten_mass(_dense(spark, folder), ["vec_id"], 0.9).withColumn("student_logprob", F.col("logprob") - (F.col("token_id") % 7) / 10.0)


@query("distill_loss", _STUDENT + "SELECT vec_id, n, round(ce, 6) AS ce FROM e")
def distill_loss(spark, folder):
    return L.distillation_loss(_student(spark, folder), ["vec_id"]).withColumn("ce", F.round("ce", 6))


@query(
    "perplexity_macro_micro",
    _STUDENT + "SELECT round(sum(ce) / sum(n), 6) AS micro_loss, round(exp(sum(ce) / sum(n)), 6) AS micro_perplexity, round(avg(ce / n), 6) AS macro_loss, round(exp(avg(ce / n)), 6) AS macro_perplexity FROM e",
)
def perplexity_macro_micro(spark, folder):
    rows = L.perplexities(L.distillation_loss(_student(spark, folder), ["vec_id"]))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])
