"""Queries on conversations, their tokens and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.tokens import VOCABULARY, count_tokens, token_ids
from textloom.operators import conversations as C
from textloom.plans.catalogue import query
from textloom.sources.tables import table

_LONG = """WITH conv AS (SELECT response_id AS conv_id, list_concat(coalesce(prompt_messages, []), [{'role': 'assistant', 'content': text}]) AS messages FROM baseline_responses),
long AS (SELECT conv_id, i - 1 AS turn, messages[i].role AS role, messages[i].content AS content FROM conv, LATERAL (SELECT unnest(range(1, len(messages) + 1)) AS i) WHERE messages[i] IS NOT NULL)
"""


def _conv(spark, folder):
    return C.from_responses(table(spark, folder, "baseline_responses", "response_id", "prompt_messages", "text"))


@query("conv_long", _LONG + "SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, content FROM long")
def conv_long(spark, folder):
    return C.to_long(_conv(spark, folder))


@query("conv_nested_rebuild", _LONG + "SELECT conv_id, CAST(count(*) AS INTEGER) AS n, string_agg(role || ':' || coalesce(content, ''), '|' ORDER BY turn) AS body FROM long GROUP BY conv_id")
def conv_nested_rebuild(spark, folder):
    nested = C.to_nested(C.to_long(_conv(spark, folder)))
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "|")
    return nested.select("conv_id", F.size("messages").alias("n"), body.alias("body"))


@query("conv_flip_roles", _LONG + "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END, ',' ORDER BY turn) AS roles FROM long GROUP BY conv_id")
def conv_flip_roles(spark, folder):
    flipped = C.flip_roles(F.filter("messages", lambda m: m.isNotNull()))
    return _conv(spark, folder).select("conv_id", F.array_join(F.transform(flipped, lambda m: m["role"]), ",").alias("roles"))


@query(
    "conv_prompt_answer",
    _LONG + """SELECT conv_id, string_agg(content, '\n' ORDER BY turn) FILTER (turn < n - 1) AS prompt, max(content) FILTER (turn = n - 1) AS answer,
    CAST(sum(len(regexp_extract_all(coalesce(content, ''), '\\S+'))) FILTER (turn < n - 1) AS BIGINT) AS prompt_tokens
    FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM long) WHERE n >= 2 GROUP BY conv_id""",
)
def conv_prompt_answer(spark, folder):
    rows = C.prompt_and_answer(_conv(spark, folder))
    prompt = F.array_join(F.transform("prompt", lambda m: m["content"]), "\n")
    tokens = F.aggregate("prompt", F.lit(0).cast("long"), lambda n, m: n + count_tokens(m["content"]))
    return rows.select("conv_id", prompt.alias("prompt"), "answer", tokens.alias("prompt_tokens"))


@query(
    "conv_role_token_counts",
    _LONG + """SELECT role, count(*) AS messages, CAST(sum(len(regexp_extract_all(coalesce(content, ''), '\\S+'))) AS BIGINT) AS tokens,
    CAST(sum(len(coalesce(content, '')) // 4 + 1) AS BIGINT) AS estimated, CAST(sum(3 + len(regexp_extract_all(coalesce(content, ''), '\\S+')) + 1) AS BIGINT) AS billed FROM long GROUP BY role""",
)
def conv_role_token_counts(spark, folder):
    """Tokens by role; the character estimate; three tokens a message and one for its role besides its own."""
    rows = C.to_long(_conv(spark, folder)).withColumn("t", count_tokens("content"))
    chars = F.length(F.coalesce("content", F.lit("")))
    return rows.groupBy("role").agg(F.count("*").alias("messages"), F.sum("t").alias("tokens"), F.sum(F.floor(chars / 4) + 1).alias("estimated"), F.sum(F.col("t") + 4).alias("billed"))


@query(
    "usage_sum",
    """SELECT sample_idx, CAST(sum(num_system_and_user_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(num_assistant_tokens) AS BIGINT) AS completion_tokens,
    CAST(sum(coalesce(num_system_and_user_tokens, 0) + coalesce(num_assistant_tokens, 0)) AS BIGINT) AS total_tokens, round(avg(num_system_and_user_tokens), 6) AS mean_prompt, count(*) AS n FROM baseline_responses GROUP BY sample_idx""",
)
def usage_sum(spark, folder):
    """Usage records add up field by field; null counts are left out of sums and means."""
    p, c = "num_system_and_user_tokens", "num_assistant_tokens"
    both = F.coalesce(p, F.lit(0)) + F.coalesce(c, F.lit(0))
    return table(spark, folder, "baseline_responses", "sample_idx", p, c).groupBy("sample_idx").agg(
        F.sum(p).alias("prompt_tokens"), F.sum(c).alias("completion_tokens"), F.sum(both).alias("total_tokens"), F.round(F.avg(p), 6).alias("mean_prompt"), F.count("*").alias("n")
    )


@query(
    "token_offsets",
    _LONG + """, sized AS (SELECT conv_id, turn, role, 3 AS start_tokens, len(regexp_extract_all(coalesce(content, ''), '\\S+')) AS own_tokens, 2 AS end_tokens FROM long)
    SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, CAST(start_tokens AS BIGINT) AS start_tokens, CAST(own_tokens AS BIGINT) AS own_tokens, CAST(end_tokens AS BIGINT) AS end_tokens,
    CAST(coalesce(sum(start_tokens + own_tokens + end_tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sized""",
)
def token_offsets(spark, folder):
    return C.message_offsets(C.to_long(_conv(spark, folder)), "qwen").drop("content")


def _element_sql(family: str, start: dict, end: list, extra: list) -> str:
    ids = f"CASE role {' '.join(f'WHEN {chr(39)}{r}{chr(39)} THEN {s}' for r, s in start.items())} END"
    own = f"list_transform(regexp_extract_all(coalesce(content, ''), '\\S+'), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {VOCABULARY} AS INTEGER))"
    return _LONG + f""", m AS (SELECT conv_id, turn, role, {ids} AS s, {own} AS o FROM long),
    tok AS (SELECT conv_id, turn, role, list_concat(s, o, {end}, {extra}) AS ids, len(s) AS ns, len(o) + {len(end)} AS nt FROM m),
    pos AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tok)
    SELECT conv_id, CAST(sum(len(ids)) AS INTEGER) AS n, CAST(sum(list_sum(ids)) AS BIGINT) AS id_sum, CAST(sum(CASE WHEN role = 'assistant' THEN nt ELSE 0 END) AS INTEGER) AS targets,
    CAST(coalesce(min(base + ns) FILTER (role = 'assistant' AND nt > 0), -1) AS INTEGER) AS first_target FROM pos GROUP BY conv_id"""


def _element(family: str):
    def run(spark, folder):
        rows = C.to_element(_conv(spark, folder), family)
        total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda n, x: n + x)
        return rows.select("conv_id", F.size("input_ids").alias("n"), total.alias("id_sum"), F.size("target_idx").alias("targets"), F.coalesce(F.array_min("target_idx"), F.lit(-1)).alias("first_target"))

    return run


query("element_qwen", _element_sql("qwen", {"user": [151644, 872, 198], "assistant": [151644, 77091, 198], "system": [151644, 8948, 198]}, [151645], [198]))(_element("qwen"))
query("element_llama", _element_sql("llama", {"user": [128006, 882, 128007, 271], "assistant": [128006, 78191, 128007, 271], "system": [128006, 9125, 128007, 271]}, [128009], []))(_element("llama"))

# Stored tokens: every second answer's ids end with the end token, every third prompt has ids of its own; each answer's first five tokens have a log probability.
_STORED_SQL = _LONG + f""", m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = count(*) OVER (PARTITION BY conv_id) AS is_last, turn, role, CASE role WHEN 'user' THEN [151644, 872, 198] WHEN 'assistant' THEN [151644, 77091, 198] WHEN 'system' THEN [151644, 8948, 198] ELSE [] END AS s,
    list_concat(list_transform(regexp_extract_all(coalesce(content, ''), '\\S+'), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {VOCABULARY} AS INTEGER)), CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN [151645] ELSE [] END) AS o FROM long),
    tok AS (SELECT *, list_concat(s, o, CASE WHEN is_last THEN [] WHEN role = 'assistant' AND conv_id % 2 = 0 THEN [198] WHEN role IN ('user', 'assistant', 'system') THEN [151645, 198] ELSE [] END) AS ids FROM m),
    pos AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM tok),
    t AS (SELECT conv_id, base + len(s) + i AS place FROM pos, LATERAL (SELECT unnest(range(0, least(len(o), 5))) AS i) WHERE role = 'assistant')
    SELECT conv_id, CAST(sum(len(ids)) AS INTEGER) AS n, CAST(sum(list_sum(ids)) AS BIGINT) AS id_sum, CAST(coalesce(any_value(tn), 0) AS INTEGER) AS targets, CAST(coalesce(any_value(ts), 0) AS BIGINT) AS target_sum
    FROM pos LEFT JOIN (SELECT conv_id, count(*) AS tn, sum(place) AS ts FROM t GROUP BY conv_id) USING (conv_id) GROUP BY conv_id"""


@query("element_stored", _STORED_SQL)
def element_stored(spark, folder):
    """Training elements by the ids that the model gave, with its log probabilities at their places."""
    def stored(m):
        ids = token_ids(F.coalesce(m["content"], F.lit(""))).cast("array<int>")
        ids = F.when((m["role"] == "assistant") & (F.col("conv_id") % 2 == 0), F.concat(ids, F.array(F.lit(151645)))).otherwise(ids)
        has = (m["role"] == "assistant") | (F.col("conv_id") % 3 == 0)
        lp = F.when(m["role"] == "assistant", F.transform(F.slice(ids, 1, 5), lambda t, i: F.struct(i.cast("int").alias("token_idx"), t.alias("token_id"), (-0.1 * (i + 1)).cast("double").alias("logprob"))))
        return F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(has, ids).alias("token_ids"), lp.alias("logprobs"))

    conv = _conv(spark, folder)
    rows = conv.select("conv_id", F.transform("messages", lambda m: F.when(m.isNotNull(), stored(m))).cast(C.STORED).alias("messages"))
    out = C.to_stored_element(rows, "qwen")
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda n, x: n + x)
    places = F.aggregate("targets", F.lit(0).cast("long"), lambda n, x: n + x["token_idx"])
    return out.select("conv_id", F.size("input_ids").alias("n"), total.alias("id_sum"), F.size("targets").alias("targets"), places.alias("target_sum"))


_THREAD = """WITH long AS (SELECT row_id AS conv_id, i - 1 AS turn, messages[i].content AS content FROM threads, LATERAL (SELECT unnest(range(1, len(messages) + 1)) AS i) WHERE messages[i] IS NOT NULL)
"""


@query(
    "conv_context_suffix_fit",
    _THREAD + """SELECT conv_id, min(CAST(turn AS INTEGER)) AS first_turn, count(*) AS kept, CAST(max(s) AS BIGINT) AS tokens FROM
    (SELECT *, sum(len(regexp_extract_all(coalesce(content, ''), '\\S+'))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM long) WHERE s <= 600 GROUP BY conv_id""",
)
def conv_context_suffix_fit(spark, folder):
    """Leading messages of a thread are dropped until the rest has at most 600 tokens."""
    rows = table(spark, folder, "threads", "row_id", "messages").select(F.col("row_id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).where("m is not null").select("conv_id", "turn", "m.content")
    kept = C.fit_suffix(rows, 600, count_tokens("content"))
    return kept.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("kept"), F.max("size_to_end").alias("tokens"))


@query(
    "conv_longest_common_prefix",
    """WITH h AS (SELECT id AS conv_id, row_id AS ord, list_transform(coalesce(messages, []), lambda m: coalesce(m.id, '') || coalesce(m.content, '')) AS ms FROM threads WHERE id IS NOT NULL),
    p AS (SELECT a.conv_id, a.ord, n FROM h a JOIN h b ON a.conv_id = b.conv_id AND b.ord < a.ord, LATERAL (SELECT unnest(range(1, least(len(a.ms), len(b.ms)) + 1)) AS n) WHERE a.ms[1:n] = b.ms[1:n])
    SELECT h.conv_id, h.ord, CAST(coalesce(max(n), 0) AS INTEGER) AS prefix FROM h LEFT JOIN p USING (conv_id, ord) GROUP BY ALL""",
)
def conv_longest_common_prefix(spark, folder):
    """Of each fetch of a thread, how many of its first messages an earlier fetch had too."""
    text = F.transform("messages", lambda m: F.concat(F.coalesce(m["id"], F.lit("")), F.coalesce(m["content"], F.lit(""))))
    rows = table(spark, folder, "threads", "row_id", "id", "messages").where("id is not null")
    return C.common_prefix(rows.select(F.col("id").alias("conv_id"), F.col("row_id").alias("ord"), F.coalesce(text, F.array().cast("array<string>")).alias("messages")))
