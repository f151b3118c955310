"""Queries on mail scans, prompts, token streams and small lookups."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textloom.functions.hashing import draw, draw_sql
from textloom.operators import conversations as C
from textloom.operators import streams_of_tokens as K
from textloom.operators import synthesis as S
from textloom.plans.catalogue import query
from textloom.sources.tables import table


@query("label_list", "SELECT DISTINCT label FROM threads WHERE label IS NOT NULL")
def label_list(spark, folder):
    return table(spark, folder, "threads", "label").where("label is not null").distinct()


@query("threads_fetch", f"SELECT row_id FROM (SELECT row_id, fetched_at FROM threads WHERE label IN ('INBOX', 'SENT') AND fetched_at >= TIMESTAMP '2024-01-01' AND fetched_at < TIMESTAMP '2024-12-31' + INTERVAL 1 DAY ORDER BY fetched_at DESC, row_id LIMIT 100) ORDER BY {draw_sql('pool', 'row_id')}, row_id LIMIT 20")
def threads_fetch(spark, folder):
    """Threads of known labels up to and with an end day: of a pool of the five times newest, some drawn. Unknown labels match nothing."""
    names = spark.createDataFrame([("INBOX",), ("SENT",), ("NO_SUCH_LABEL",)], "label string")
    rows = table(spark, folder, "threads", "row_id", "label", "fetched_at").join(F.broadcast(names), "label", "left_semi")
    rows = rows.where("fetched_at >= timestamp'2024-01-01' and fetched_at < timestamp'2024-12-31' + interval 1 day")
    pool = rows.orderBy(F.desc("fetched_at"), "row_id").limit(100)
    return pool.orderBy(draw("pool", "row_id"), "row_id").limit(20).select("row_id")


@query("answerable_questions", "SELECT pair_id, question, json_extract_string(old_answer, '$.extractive_spans[0]') AS span FROM qasper_pairs WHERE json_valid(old_answer) AND json_extract_string(old_answer, '$.unanswerable') = 'false'")
def answerable_questions(spark, folder):
    """Questions whose first annotated answer does not say that they cannot be answered."""
    v = F.try_parse_json("old_answer")
    rows = table(spark, folder, "qasper_pairs", "pair_id", "question", "old_answer").withColumn("v", v)
    return rows.where(F.try_variant_get("v", "$.unanswerable", "boolean") == False).select("pair_id", "question", F.try_variant_get("v", "$.extractive_spans[0]", "string").alias("span"))  # noqa: E712


_MOCK = lambda s, p: f"array_to_string(regexp_extract_all({s}, '\\S+')[1:5], ' ') || ' [' || length({p}) || ']'"


@query("question_rewrite", f"""WITH q AS (SELECT pair_id, question, json_extract_string(old_answer, '$.extractive_spans[0]') AS span FROM qasper_pairs WHERE json_valid(old_answer) AND json_extract_string(old_answer, '$.unanswerable') = 'false'), a AS (SELECT *, coalesce(span, '') AS context FROM q),
b AS (SELECT *, {_MOCK('context', "coalesce(question, '')")} AS new_question FROM a) SELECT *, {_MOCK('context', 'new_question')} AS new_answer FROM b""")
def question_rewrite(spark, folder):
    """Answerable questions and then their answers rewritten by the (mock) model, one call after the other."""
    rows = answerable_questions(spark, folder).withColumn("context", F.coalesce("span", F.lit("")))
    rows = S.ask(rows, "context", "question", "new_question", S.mock_model)
    rows = S.ask(rows, "context", "new_question", "new_answer", S.mock_model)
    return rows.select("pair_id", "question", "span", "context", "new_question", "new_answer")


@query("context_truncate", "SELECT doc_id, len(w) AS tokens, array_to_string(w[1:200], ' ') AS context FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS w FROM documents)")
def context_truncate(spark, folder):
    """Contexts cut to the tokens that a baseline's prompt may hold."""
    from textloom.functions.tokens import split_tokens

    w = split_tokens(F.coalesce("text", F.lit("")))
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("tokens"), F.array_join(F.slice("w", 1, 200), " ").alias("context"))


@query("attention_mask", "SELECT q, CAST(sum(CASE WHEN seqk = -1 OR (seqq = seqk AND k <= q) THEN 1 ELSE 0 END) AS BIGINT) AS visible FROM (SELECT a.i AS q, b.i AS k, a.i // 16 AS seqq, CASE WHEN b.i < 8 THEN -1 ELSE b.i // 16 END AS seqk FROM (SELECT unnest(range(0, 64)) AS i) a, (SELECT unnest(range(0, 64)) AS i) b) GROUP BY q")
def attention_mask(spark, folder):
    """How many places each place of a packed batch of 64 sees; a demonstration on a fixed, small range."""
    q, k = spark.range(64).withColumnRenamed("id", "q"), spark.range(64).withColumnRenamed("id", "k")
    seq = lambda c: F.floor(F.col(c) / 16)
    hit = K.visible(F.col("q"), F.col("k"), seq("q"), F.when(F.col("k") < 8, -1).otherwise(seq("k")))
    return q.crossJoin(F.broadcast(k)).groupBy("q").agg(F.sum(hit.cast("long")).alias("visible"))


@query("word_product", "SELECT DISTINCT a || '-' || n AS word FROM (SELECT unnest(['calm', 'brave', 'quick', 'calm']) AS a), (SELECT unnest(['river', 'stone', 'cloud']) AS n)")
def word_product(spark, folder):
    a = spark.createDataFrame([("calm",), ("brave",), ("quick",), ("calm",)], "a string")
    n = spark.createDataFrame([("river",), ("stone",), ("cloud",)], "n string")
    return a.crossJoin(F.broadcast(n)).select(F.concat_ws("-", "a", "n").alias("word")).distinct().orderBy("word")


@query("system_prompt_truncate", "SELECT response_id, len(ids) AS n, ids[-1] AS last FROM (SELECT response_id, CASE WHEN len(t) <= 40 THEN t ELSE list_concat(t[1:38], [7, 8]) END AS ids FROM (SELECT response_id, list_concat(list_transform(regexp_extract_all(coalesce(text, ''), '\\S+'), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 50000 AS INTEGER)), [7, 8]) AS t FROM baseline_responses))")
def system_prompt_truncate(spark, folder):
    from textloom.functions.tokens import token_ids

    ids = F.concat(token_ids(F.coalesce("text", F.lit(""))), F.array(F.lit(7), F.lit(8)))
    rows = table(spark, folder, "baseline_responses", "response_id", "text").select("response_id", K.cut_keeping_end(ids, 40, [7, 8]).alias("ids"))
    return rows.select("response_id", F.size("ids").cast("long").alias("n"), F.element_at("ids", -1).alias("last"))


@query("split_header_tokens", """WITH conv AS (SELECT response_id AS conv_id, list_concat(coalesce(prompt_messages, []), [{'role': 'assistant', 'content': text}]) AS m FROM baseline_responses) SELECT conv_id, CAST(i AS BIGINT) AS message, m[i].role AS role, len(regexp_extract_all(coalesce(m[i].content, ''), '\\S+')) AS n FROM conv, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) WHERE m[i] IS NOT NULL""")
def split_header_tokens(spark, folder):
    """Conversations written as one token stream with headers, and read from it again."""
    from textloom.functions.tokens import split_tokens

    conv = C.from_responses(table(spark, folder, "baseline_responses", "response_id", "prompt_messages", "text"))
    part = lambda m: F.concat(F.array(F.lit("<s>"), m["role"], F.lit("</h>")), split_tokens(F.coalesce(m["content"], F.lit(""))), F.array(F.lit("<eot>")))
    stream = conv.select("conv_id", F.posexplode(F.flatten(F.transform(F.filter("messages", lambda m: m.isNotNull()), part))).alias("pos", "token"))
    return K.split_by_headers(stream, "conv_id", "pos", "token", "<s>", "</h>", "<eot>").select("conv_id", "message", "role", F.size("tokens").cast("long").alias("n"))


@query("chat_undo", "SELECT row_id, greatest(len(messages) - 2, 0) AS n FROM threads WHERE messages IS NOT NULL")
def chat_undo(spark, folder):
    return table(spark, folder, "threads", "row_id", "messages").where("messages is not null").select("row_id", F.size(K.undo(F.col("messages"))).cast("long").alias("n"))


@query("embedding_cache", "SELECT count(*) AS texts, count(DISTINCT sha256(text)) AS to_embed FROM documents WHERE text IS NOT NULL")
def embedding_cache(spark, folder):
    """Texts that share a vector by content hash: how many there are, and how many must be embedded."""
    d = table(spark, folder, "documents", "text").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("texts"), F.count("*").alias("to_embed"))


@query("packed_arrays", "SELECT vec_id, CAST(len(embedding) // 8 AS INTEGER) AS n_rows, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def packed_arrays(spark, folder):
    """Vectors encoded as base64 of 32-bit floats, decoded and reshaped to rows of eight."""
    @F.pandas_udf("string")
    def encode(v: pd.Series) -> pd.Series:
        return pd.Series([base64.b64encode(np.asarray(x, "<f4").tobytes()).decode() for x in v])

    rows = table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", K.decode_floats(encode("embedding")).alias("v"))
    return rows.select("vec_id", F.size(K.reshape(F.col("v"), 8)).alias("n_rows"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("tool_template", """SELECT event_type, '{"type":"function","function":{"name":"' || event_type || '","parameters":{"k":"integer"}}}' AS line FROM (SELECT DISTINCT event_type FROM events)""")
def tool_template(spark, folder):
    """Tool definitions as JSON lines, each encoded once."""
    t = table(spark, folder, "events", "event_type").distinct()
    fn = F.struct(F.col("event_type").alias("name"), F.struct(F.lit("integer").alias("k")).alias("parameters"))
    return t.select("event_type", F.to_json(F.struct(F.lit("function").alias("type"), fn.alias("function"))).alias("line"))


@query("score_colour", "SELECT event_id, CASE WHEN value / 100 < 0.5 THEN 'red' WHEN value / 100 < 0.8 THEN 'yellow' ELSE 'green' END AS colour FROM events WHERE value IS NOT NULL")
def score_colour(spark, folder):
    s = F.col("value") / 100
    return table(spark, folder, "events", "event_id", "value").where("value is not null").select("event_id", F.when(s < 0.5, "red").when(s < 0.8, "yellow").otherwise("green").alias("colour"))


@query("prompt_templates", "SELECT pair_id, 'Question: ' || question || chr(10) || CASE pair_id % 2 WHEN 0 THEN 'Answer directly.' ELSE 'Think step by step, then answer inside <answer> tags.' END AS prompt FROM qasper_pairs WHERE question IS NOT NULL")
def prompt_templates(spark, folder):
    """Direct and step-by-step prompts by template."""
    style = F.when(F.col("pair_id") % 2 == 0, "Answer directly.").otherwise("Think step by step, then answer inside <answer> tags.")
    return table(spark, folder, "qasper_pairs", "pair_id", "question").where("question is not null").select("pair_id", F.concat(F.lit("Question: "), "question", F.lit("\n"), style).alias("prompt"))


@query("last_by_sequence", "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type FROM events GROUP BY user_id")
def last_by_sequence(spark, folder):
    return table(spark, folder, "events", "user_id", "ts", "event_id", "event_type").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
