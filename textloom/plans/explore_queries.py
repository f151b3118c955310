"""Queries on evaluation tables and on the explorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import conversations as C
from textloom.operators import evaluation as E
from textloom.operators import explore as X
from textloom.plans.catalogue import query
from textloom.sources.tables import table


def _events(spark, folder):
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select("event_id", "user_id", (F.col("event_id") % 5).alias("sample_idx"), F.dayofmonth("ts").alias("step"), F.col("event_type").alias("depth"), (F.col("user_id") % 7).alias("file_level"), (F.col("value") / 100).alias("score"), (F.col("value") / 50).alias("length_score"))


_E = "WITH e AS (SELECT event_id, user_id, event_id % 5 AS sample_idx, CAST(day(ts) AS INTEGER) AS step, event_type AS depth, user_id % 7 AS file_level, value / 100 AS score, value / 50 AS length_score FROM events)\n"


@query("mean_scores", _E + 'SELECT round(avg(score), 6) AS "generate_score", round(avg(length_score), 6) AS "generate_length_score" FROM e')
def mean_scores(spark, folder):
    means = E.mean_scores(_events(spark, folder), "generate_")
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query("mean_scores_by_slice", _E + "SELECT 'depth' AS slice, depth AS key, count(*) AS n, round(avg(score), 6) AS score FROM e GROUP BY depth UNION ALL SELECT 'depth+file_level', depth || '/' || file_level, count(*), round(avg(score), 6) FROM e GROUP BY depth, file_level")
def mean_scores_by_slice(spark, folder):
    return E.slice_means(_events(spark, folder), [["depth"], ["depth", "file_level"]], ["score"]).withColumn("score", F.round("score", 6))


@query("slice_grouping_sets", _E + "SELECT depth, file_level, grouping(depth, file_level) AS set_id, count(*) AS n, round(avg(score), 6) AS score FROM e GROUP BY GROUPING SETS ((depth), (file_level))")
def slice_grouping_sets(spark, folder):
    rows = E.grouping_means(_events(spark, folder), [["depth"], ["file_level"]], ["score"])
    return rows.withColumn("score", F.round("score", 6))


@query("slice_over_time", _E + "SELECT step, depth AS slice, count(*) AS n, round(avg(score), 6) AS score FROM e GROUP BY step, depth")
def slice_over_time(spark, folder):
    return _events(spark, folder).groupBy("step", F.col("depth").alias("slice")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


@query("dedup_eval_rows", _E + "SELECT user_id, sample_idx, event_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, sample_idx ORDER BY event_id) AS r FROM e) WHERE r = 1")
def dedup_eval_rows(spark, folder):
    return E.first_of(_events(spark, folder), ["user_id", "sample_idx"], ["event_id"]).select("user_id", "sample_idx", "event_id", F.round("score", 6).alias("score"))


@query("union_slices_dedup", _E + "SELECT user_id, depth, min(event_id) AS event_id FROM (SELECT user_id, depth, event_id FROM e WHERE depth = 'click' UNION ALL SELECT user_id, depth, event_id FROM e WHERE file_level < 3) GROUP BY user_id, depth")
def union_slices_dedup(spark, folder):
    e = _events(spark, folder).select("user_id", "depth", "event_id")
    return E.distinct_rows([e.where("depth = 'click'"), _events(spark, folder).where("file_level < 3").select("user_id", "depth", "event_id")], "event_id")


@query("fuzzy_choice")
def fuzzy_choice(spark, folder):
    """Which of four answers of the same language a response is most like; the first is the reference."""
    r = table(spark, folder, "baseline_responses", "response_id", "pair_id", "text").join(table(spark, folder, "qasper_pairs", "pair_id", "answer", "question", "title"), "pair_id")
    options = F.array(*[F.coalesce(c, F.lit("")) for c in (F.col("answer"), F.col("question"), F.col("title"), F.lit("No"))])
    return E.best_option(r.select("response_id", F.coalesce("text", F.lit("")).alias("text"), options.alias("options")), "text", "options").select("response_id", "best", (F.col("best") == 0).alias("correct"))


def _chrf_sql() -> str:
    clean = lambda c: f"regexp_replace(coalesce({c}, ''), '\\s', '', 'g')"
    parts = []
    for n in range(1, 7):
        g = lambda c, a, b, n=n: f"SELECT id, substr({c}, CAST(i AS BIGINT), {n}) AS g, {a} AS a, {b} AS b FROM t, LATERAL (SELECT unnest(range(1, greatest(len({c}) - {n} + 2, 1))) AS i)"
        parts.append(f"SELECT {n} AS n, sum(least(a, b)) AS hit, sum(a) AS pred, sum(b) AS ref FROM (SELECT id, g, sum(a) AS a, sum(b) AS b FROM ({g('p', 1, 0)} UNION ALL {g('r', 0, 1)}) GROUP BY id, g)")
    return f"""WITH t AS (SELECT response_id AS id, {clean('text')} AS p, {clean('answer')} AS r FROM baseline_responses JOIN qasper_pairs USING (pair_id)), s AS ({' UNION ALL '.join(parts)}),
    m AS (SELECT avg(CASE WHEN pred > 0 THEN hit / pred ELSE 0 END) AS p, avg(CASE WHEN ref > 0 THEN hit / ref ELSE 0 END) AS r FROM s WHERE pred > 0 OR ref > 0) SELECT round(100 * CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM m"""


@query("chrf_corpus", _chrf_sql())
def chrf_corpus(spark, folder):
    r = table(spark, folder, "baseline_responses", "pair_id", "text").join(table(spark, folder, "qasper_pairs", "pair_id", "answer"), "pair_id")
    return E.chrf(r, F.col("text"), F.col("answer"))


@query(
    "generation_eval_table",
    """WITH q AS (SELECT pair_id, question, answer, s AS sample_idx FROM qasper_pairs, LATERAL (SELECT unnest(range(0, 2)) AS s)), a AS (SELECT pair_id, sample_idx, any_value(text) AS pred FROM (SELECT * FROM baseline_responses WHERE response_id IN (SELECT min(response_id) FROM baseline_responses GROUP BY pair_id, sample_idx)) GROUP BY ALL)
    SELECT q.pair_id, CAST(q.sample_idx AS INTEGER) AS sample_idx, CAST(coalesce(lower(trim(pred)) = lower(trim(answer)), FALSE) AS DOUBLE) AS exact_score, CAST(coalesce(contains(lower(pred), lower(answer)), FALSE) AS DOUBLE) AS contains_score FROM q LEFT JOIN a ON q.pair_id = a.pair_id AND q.sample_idx = a.sample_idx""",
)
def generation_eval_table(spark, folder):
    asked = table(spark, folder, "qasper_pairs", "pair_id", "question", "answer")
    made = table(spark, folder, "baseline_responses", "response_id", "pair_id", "sample_idx", "text")
    made = E.first_of(made, ["pair_id", "sample_idx"], ["response_id"]).select("pair_id", "sample_idx", F.col("text").alias("pred"))
    return E.generation_table(asked, 2, made, ["exact", "contains"], "pair_id").select("pair_id", "sample_idx", "exact_score", "contains_score")


@query("search_page", "SELECT response_id FROM (SELECT response_id FROM baseline_responses WHERE contains(lower(coalesce(text, '')), 'memory') OR list_bool_or(list_transform(prompt_messages, lambda m: contains(lower(m.content), 'memory'))) ORDER BY response_id LIMIT 12 OFFSET 24)")
def search_page(spark, folder):
    """Third page of twelve of the conversations that mention a word."""
    conv = C.from_responses(table(spark, folder, "baseline_responses", "response_id", "prompt_messages", "text"))
    return X.page(X.search(conv, " Memory ", messages="messages"), ["conv_id"], 2, 12).select(F.col("conv_id").alias("response_id"))


@query("search_fields", "SELECT row_id FROM messages WHERE contains(lower(coalesce(subject, '')), 'meeting')")
def search_fields(spark, folder):
    return X.search(table(spark, folder, "messages", "row_id", "subject"), "MEETING", system="subject").select("row_id")


@query("neighbour_nav", "SELECT source, doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next FROM documents")
def neighbour_nav(spark, folder):
    return X.neighbours(table(spark, folder, "documents", "source", "doc_id"), "doc_id", "source")


@query("get_by_index", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 1 OFFSET 17")
def get_by_index(spark, folder):
    return X.page(table(spark, folder, "documents", "doc_id", "lang", "source"), ["doc_id"], 17, 1)


@query("runs_filter", "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND CAST(json_extract(props, '$.k') AS INTEGER) < 50 AND regexp_matches(CAST(user_id AS VARCHAR), '^1') GROUP BY user_id ORDER BY user_id LIMIT 20 OFFSET 5")
def runs_filter(spark, folder):
    """Runs by tag list, by a value of their configuration and by id pattern; one page of them."""
    rows = table(spark, folder, "events", "user_id", "event_type", "props").where(F.col("event_type").isin("click", "view") & (F.get_json_object("props", "$.k").cast("int") < 50) & F.col("user_id").cast("string").rlike("^1"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n")).orderBy("user_id").offset(5).limit(20)


@query("history_last_step", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def history_last_step(spark, folder):
    return X.last_at_step(table(spark, folder, "events", "user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("checkpoints_retain", "WITH f AS (SELECT 'run' || (user_id % 9) || '/cache-' || CASE WHEN user_id % 2 = 0 THEN 'step' ELSE 'epoch' END || user_id || '.pt' AS path, 'run' || (user_id % 9) AS folder, user_id AS step FROM (SELECT DISTINCT user_id FROM events)) SELECT path, step, row_number() OVER (PARTITION BY folder ORDER BY step DESC) > 3 AS \"delete\" FROM f")
def checkpoints_retain(spark, folder):
    u = table(spark, folder, "events", "user_id").distinct()
    kind = F.when(F.col("user_id") % 2 == 0, "step").otherwise("epoch")
    files = u.select(F.concat(F.lit("run"), (F.col("user_id") % 9).cast("string"), F.lit("/cache-"), kind, F.col("user_id").cast("string"), F.lit(".pt")).alias("path"))
    return X.retention(files, "path", 3)


@query("serve_rows", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents")
def serve_rows(spark, folder):
    return X.serve(table(spark, folder, "documents", "doc_id", "lang", "source"))


@query("drop_empty_columns", "SELECT doc_id, lang FROM documents")
def drop_empty_columns(spark, folder):
    return X.drop_empty_columns(table(spark, folder, "documents", "doc_id", "lang").withColumn("nothing", F.lit(None).cast("string")))


@query("conversation_detect", "SELECT pair_id, FALSE AS is_conversation FROM qasper_pairs UNION ALL SELECT response_id + 1000000, prompt_messages IS NOT NULL AND len(prompt_messages) > 0 FROM baseline_responses")
def conversation_detect(spark, folder):
    """Which JSON texts are conversations: old answers are not, prompts are."""
    a = table(spark, folder, "qasper_pairs", "pair_id", "old_answer").select("pair_id", F.col("old_answer").alias("j"))
    b = table(spark, folder, "baseline_responses", "response_id", "prompt_messages").select((F.col("response_id") + 1000000).alias("pair_id"), F.to_json("prompt_messages").alias("j"))
    return a.unionAll(b).select("pair_id", X.is_conversation("j").alias("is_conversation"))


@query("json_flatten_leaves", """SELECT pair_id, replace(replace(replace(t.fullkey, '$.', ''), '[', '/'), ']', '') AS path, CASE WHEN t.type = 'BOOLEAN' THEN CASE WHEN t.value::VARCHAR = 'true' THEN 'True' ELSE 'False' END WHEN t.type = 'NULL' THEN 'None' ELSE json_extract_string(t.value, '$') END AS value
FROM qasper_pairs, json_tree(CASE WHEN json_valid(old_answer) THEN CAST(old_answer AS JSON) END) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def json_flatten_leaves(spark, folder):
    return X.leaf_paths(table(spark, folder, "qasper_pairs", "pair_id", "old_answer"), "pair_id", "old_answer")


@query("json_all_paths")
def json_all_paths(spark, folder):
    """Every value of the old answers with its path, containers included, in the order of the text."""
    return X.json_paths(table(spark, folder, "qasper_pairs", "pair_id", "old_answer"), "pair_id", "old_answer")
