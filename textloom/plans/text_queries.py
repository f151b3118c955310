"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import hashing as H
from textloom.functions import text as T
from textloom.functions.tokens import split_tokens
from textloom.plans.catalogue import query
from textloom.sources.tables import table


@query("chunk_fixed_chars", "SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(text, CAST(i * 500 + 1 AS BIGINT), 500) AS chunk FROM documents, LATERAL (SELECT unnest(range(0, (len(text) - 1) // 500 + 1)) AS i) WHERE len(text) > 0")
def chunk_fixed_chars(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.inline(T.fixed_chunks("text", 500)))


@query(
    "chunk_token_window",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w, 32 + {H.draw_sql('len', 'doc_id')} % 97 AS want, {H.draw_sql('start', 'doc_id')} AS u FROM documents WHERE text IS NOT NULL),
    n AS (SELECT *, least(want, len(w)) AS n FROM t) SELECT doc_id, n AS tokens, array_to_string(w[(u % (len(w) - n + 1)) + 1:(u % (len(w) - n + 1)) + n], ' ') AS chunk FROM n WHERE len(w) > 0""",
)
def chunk_token_window(spark, folder):
    """A window of 32 to 128 tokens at a drawn place; the whole text if it is shorter."""
    rows = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", split_tokens("text").alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("n", F.least(F.lit(32) + H.draw("len", "doc_id") % 97, F.size("w").cast("long")))
    start = H.draw("start", "doc_id") % (F.size("w") - F.col("n") + 1)
    return rows.select("doc_id", F.col("n").alias("tokens"), F.array_join(F.slice("w", (start + 1).cast("int"), F.col("n").cast("int")), " ").alias("chunk"))


@query("chunk_char_window", f"SELECT doc_id, substr(text, {H.draw_sql('char', 'doc_id')} % greatest(len(text) - 300 + 1, 1) + 1, 300) AS chunk FROM documents WHERE len(text) > 0")
def chunk_char_window(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "text").where(F.length("text") > 0)
    start = H.draw("char", "doc_id") % F.greatest(F.length("text") - 300 + 1, F.lit(1))
    return rows.select("doc_id", F.substr("text", (start + 1).cast("int"), F.lit(300)).alias("chunk"))


@query(
    "sentence_windows",
    f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(k AS INTEGER) AS k, array_to_string(s[({H.draw_sql('sent', 'doc_id', 'k')} % greatest(len(s) - 1, 1)) + 1:({H.draw_sql('sent', 'doc_id', 'k')} % greatest(len(s) - 1, 1)) + 2], ' ') AS chunk
    FROM s, LATERAL (SELECT unnest(range(0, 3)) AS k) WHERE len(s) > 0""",
)
def sentence_windows(spark, folder):
    """Three windows of two sentences of each document."""
    rows = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.sentences("text").alias("s")).where(F.size("s") > 0)
    rows = rows.select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    start = H.draw("sent", "doc_id", "k") % F.greatest(F.size("s") - 1, F.lit(1))
    return rows.select("doc_id", "k", F.array_join(F.slice("s", (start + 1).cast("int"), 2), " ").alias("chunk"))


@query("tag_extract", "SELECT response_id, CASE WHEN regexp_matches(text, '(?s)<answer>(.*?)</answer>') THEN lower(trim(regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1))) END AS strict, lower(trim(CASE WHEN regexp_matches(text, '(?si)<answer>(.*?)</answer>') THEN regexp_extract(text, '(?si)<answer>(.*?)</answer>', 1) ELSE text END)) AS lenient FROM baseline_responses")
def tag_extract(spark, folder):
    return table(spark, folder, "baseline_responses", "response_id", "text").select("response_id", T.first_tag("text", "answer").alias("strict"), T.first_tag("text", "answer", ignore_case=True, fallback=True).alias("lenient"))


@query(
    "tag_set_f1",
    """WITH p AS (SELECT pair_id, string_split(lower(answer), ' ') AS a, string_split(lower(coalesce(old_answer, '')), ' ') AS b FROM qasper_pairs WHERE answer IS NOT NULL),
    s AS (SELECT pair_id, list_distinct(list_filter(a, lambda x: x <> '')) AS a, list_distinct(list_filter(b, lambda x: x <> '')) AS b FROM p),
    k AS (SELECT pair_id, len(list_intersect(a, b)) AS tp, len(a) AS na, len(b) AS nb FROM s)
    SELECT pair_id, CAST(tp AS INTEGER) AS tp, CAST(na - tp AS INTEGER) AS fp, CAST(nb - tp AS INTEGER) AS fn, round(CASE WHEN na > 0 THEN tp / na ELSE 0 END, 6) AS "precision", round(CASE WHEN nb > 0 THEN tp / nb ELSE 0 END, 6) AS recall, round(CASE WHEN na + nb > 0 THEN 2.0 * tp / (na + nb) ELSE 0 END, 6) AS f1 FROM k""",
)
def tag_set_f1(spark, folder):
    """Overlap of the sets of words of a rewritten and an old answer."""
    rows = table(spark, folder, "qasper_pairs", "pair_id", "answer", "old_answer").where("answer is not null")
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), " "), lambda w: w != ""))
    return set_f1(rows.select("pair_id", words("answer").alias("a"), words("old_answer").alias("b")), "pair_id")


def set_f1(rows, key):
    """(key, tp, fp, fn, precision, recall, f1) of array columns a (predicted) and b (wanted)."""
    rows = rows.select(key, F.size(F.array_intersect("a", "b")).alias("tp"), F.size("a").alias("na"), F.size("b").alias("nb"))
    share = lambda n, d: F.round(F.when(d > 0, n / d).otherwise(0.0), 6)
    tp, na, nb = F.col("tp"), F.col("na"), F.col("nb")
    return rows.select(key, "tp", (na - tp).alias("fp"), (nb - tp).alias("fn"), share(tp, na).alias("precision"), share(tp, nb).alias("recall"), share(2.0 * tp, na + nb).alias("f1"))


@query(
    "niah_exact_match",
    """SELECT response_id, list_sort(list_distinct(list_transform(string_split(trim(split_part(coalesce(text, ''), ':', -1), '{}''" .,' || chr(9) || chr(10)), ','), lambda x: trim(x, '{}''" .,' || chr(9) || chr(10))))) = list_sort(list_distinct(list_transform(string_split(trim(split_part(coalesce(answer, ''), ':', -1), '{}''" .,' || chr(9) || chr(10)), ','), lambda x: trim(x, '{}''" .,' || chr(9) || chr(10))))) AS correct FROM baseline_responses JOIN qasper_pairs USING (pair_id)""",
)
def niah_exact_match(spark, folder):
    """Equal sets of answers, whatever their order; predictions joined with their references on the key."""
    pred = table(spark, folder, "baseline_responses", "response_id", "pair_id", "text").join(table(spark, folder, "qasper_pairs", "pair_id", "answer"), "pair_id")
    parse = lambda x: F.array_sort(F.array_distinct(T.answer_set(F.coalesce(x, F.lit("")))))
    return pred.select("response_id", (parse("text") == parse("answer")).alias("correct"))


@query("post_thought", "SELECT response_id, CASE WHEN contains(t, '</think>') THEN split_part(t, '</think>', -1) ELSE t END AS said FROM (SELECT response_id, 'why</think> so</think>' || text AS t FROM baseline_responses WHERE response_id % 2 = 0 UNION ALL SELECT response_id, text FROM baseline_responses WHERE response_id % 2 = 1)")
def post_thought(spark, folder):
    rows = table(spark, folder, "baseline_responses", "response_id", "text")
    text = F.when(F.col("response_id") % 2 == 0, F.concat(F.lit("why</think> so</think>"), F.col("text"))).otherwise(F.col("text"))
    return rows.select("response_id", T.after_thought(text).alias("said"))


@query("whitespace_collapse", "SELECT row_id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content FROM messages WHERE content IS NOT NULL")
def whitespace_collapse(spark, folder):
    return table(spark, folder, "messages", "row_id", "content").where("content is not null").select("row_id", T.collapse("content").alias("content"))


@query("latex_strip", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(replace(string_split(replace(x, '\\%', chr(1)), '%')[1], chr(1), '\\%'))), lambda x: trim(x) <> ''), chr(10)) AS text FROM documents WHERE source = 'tex_project'""")
def latex_strip(spark, folder):
    """LaTeX documents without comments and empty lines."""
    rows = table(spark, folder, "documents", "doc_id", "text", "source").where("source = 'tex_project'")
    return rows.select("doc_id", T.strip_latex_comments("text").alias("text"))


@query("marker_slice", "SELECT doc_id, CASE WHEN strpos(text, '\\begin{') > 0 AND strpos(substr(text, strpos(text, '\\begin{') + 7), '\\end{') > 0 THEN substr(text, strpos(text, '\\begin{'), strpos(substr(text, strpos(text, '\\begin{') + 7), '\\end{') + 11) ELSE '' END AS part FROM documents WHERE text IS NOT NULL")
def marker_slice(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return rows.select("doc_id", T.between_markers("text", "\\begin{", "\\end{").alias("part"))


@query("html_visible_text")
def html_visible_text(spark, folder):
    """Documents wrapped as pages, and their visible text again."""
    rows = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    page = F.concat(F.lit("<html><head><title>t</title></head><body><script>x<1</script><p>"), F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    return rows.select("doc_id", T.visible_html(page).alias("text"))


@query("address_lists", "SELECT row_id, list_filter(list_transform(string_split(array_to_string(to_addresses, ','), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM messages WHERE to_addresses IS NOT NULL")
def address_lists(spark, folder):
    return table(spark, folder, "messages", "row_id", "to_addresses").where("to_addresses is not null").select("row_id", T.addresses(F.array_join("to_addresses", ",")).alias("parts"))


@query("mail_body_decode", "SELECT row_id, content AS body FROM messages WHERE content IS NOT NULL")
def mail_body_decode(spark, folder):
    """Bodies encoded as mail services send them, URL-safe and without padding, and decoded again."""
    sent = F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode("content", "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", "")
    return table(spark, folder, "messages", "row_id", "content").where("content is not null").select("row_id", T.base64url_text(sent).alias("body"))


_CALLS = """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '<tool_call>{"name": "' || event_type || '", "arguments": ' || props || '}</tool_call> and <tool_call>{"name": "late", "arguments": {"v": 1}}'
  WHEN 1 THEN '<tool_call>{"name": oops}</tool_call>' WHEN 2 THEN 'no call' ELSE '<tool_call>{"arguments": {}}</tool_call>' END AS text FROM events)
"""


def _calls(spark, folder):
    e = table(spark, folder, "events", "event_id", "event_type", "props")
    ok = F.concat(F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit('}</tool_call> and <tool_call>{"name": "late", "arguments": {"v": 1}}'))
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, ok).when(kind == 1, '<tool_call>{"name": oops}</tool_call>').when(kind == 2, "no call").otherwise('<tool_call>{"arguments": {}}</tool_call>')
    return e.select("event_id", text.alias("text"))


@query("tool_call_parse", _CALLS + "SELECT event_id, json_extract_string(b, '$.name') AS name FROM (SELECT event_id, unnest(regexp_extract_all(text, '(?s)<tool_call>(.*?)(?:</tool_call>|$)', 1)) AS b FROM t) WHERE json_valid(b) AND json_extract(b, '$.arguments') IS NOT NULL AND json_extract_string(b, '$.name') IS NOT NULL")
def tool_call_parse(spark, folder):
    return _calls(spark, folder).select("event_id", F.explode(T.tool_calls("text")).alias("b")).select("event_id", F.get_json_object("b", "$.name").alias("name"))


@query("tool_dispatch", _CALLS + """, c AS (SELECT event_id, json_extract_string(b, '$.name') AS name FROM (SELECT event_id, unnest(regexp_extract_all(text, '(?s)<tool_call>(.*?)(?:</tool_call>|$)', 1)) AS b FROM t) WHERE json_valid(b) AND json_extract(b, '$.arguments') IS NOT NULL AND json_extract_string(b, '$.name') IS NOT NULL)
SELECT name, count(*) AS calls, name IN ('click', 'view', 'late') AS known FROM c GROUP BY name""")
def tool_dispatch(spark, folder):
    """Calls by tool; a tool that is not registered gives failed outputs."""
    from textloom.operators.tools import dispatch

    calls = tool_call_parse(spark, folder)
    out = dispatch(calls, spark.createDataFrame([("click",), ("view",), ("late",)], "name string"))
    return out.groupBy("name").agg(F.count("*").alias("calls"), F.bool_and("success").alias("known"))


@query(
    "tool_run",
    """WITH c AS (SELECT event_id, event_type AS name, CASE WHEN event_id % 11 = 0 THEN '[1]' ELSE props END AS arguments, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 11 <> 0 AND name = 'click' THEN CAST(2 * k AS VARCHAR) WHEN event_id % 11 <> 0 AND name = 'view' AND k % 5 <> 0 THEN CAST(k + 1 AS VARCHAR) END AS response,
    event_id % 11 <> 0 AND (name = 'click' OR name = 'view' AND k % 5 <> 0) AS success FROM c""",
)
def tool_run(spark, folder):
    """Calls of two tools, grouped and run: one works, one fails on some arguments, other tools are unknown, some arguments are no object; each call keeps its row."""
    from textloom.operators.tools import run_tools

    def view(calls):
        if any(a["k"] % 5 == 0 for a in calls):
            raise RuntimeError("a multiple of five")
        return [a["k"] + 1 for a in calls]

    arguments = F.when(F.col("event_id") % 11 == 0, "[1]").otherwise(F.col("props"))
    calls = table(spark, folder, "events", "event_id", "event_type", "props").select("event_id", F.col("event_type").alias("name"), arguments.alias("arguments"))
    return run_tools(calls, {"click": lambda calls: [2 * a["k"] for a in calls], "view": view}).select("event_id", "response", "success")


@query("tool_output_xml", "SELECT user_id, coalesce(string_agg('<tool_call>' || event_type || '</tool_call>', chr(10) ORDER BY event_id) FILTER (value >= 50), '') AS xml FROM events GROUP BY user_id")
def tool_output_xml(spark, folder):
    """Outputs of successful calls (here: of values from 50) as text, in order, a line each."""
    from textloom.operators.tools import outputs_to_text

    rows = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    outputs = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))), lambda x: F.struct((x["value"] >= 50).alias("success"), x["event_type"].alias("response")))
    return rows.groupBy("user_id").agg(outputs.alias("o")).select("user_id", outputs_to_text("o").alias("xml"))


@query("word_top10", "SELECT source, word, n FROM (SELECT source, word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) AS r FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY source, word) WHERE r <= 10")
def word_top10(spark, folder):
    return _top_words(spark, folder, 10)


@query("word_top3", "SELECT source, word, n FROM (SELECT source, word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) AS r FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY source, word) WHERE r <= 3")
def word_top3(spark, folder):
    return _top_words(spark, folder, 3)


def _top_words(spark, folder, k):
    from pyspark.sql.window import Window

    words = table(spark, folder, "documents", "source", "text").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    n = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))).where(F.col("r") <= k).drop("r")


@query("paper_text", "WITH s AS (SELECT row_id, i, sections[i] AS x FROM papers, LATERAL (SELECT unnest(range(1, len(sections) + 1)) AS i) WHERE sections[i] IS NOT NULL) SELECT row_id, string_agg('## ' || coalesce(x.title, '') || chr(10) || array_to_string(list_filter(coalesce(x.paragraphs, []), lambda p: p IS NOT NULL), chr(10)), chr(10) ORDER BY i) AS body FROM s GROUP BY row_id")
def paper_text(spark, folder):
    """Papers as one text by template: sections in order, each with its title."""
    rows = table(spark, folder, "papers", "row_id", "sections").select("row_id", F.posexplode("sections").alias("i", "x")).where("x is not null")
    part = F.concat(F.lit("## "), F.coalesce("x.title", F.lit("")), F.lit("\n"), F.coalesce(F.array_join("x.paragraphs", "\n"), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("i", part.alias("t"))))
    return rows.groupBy("row_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("body"))


@query("config_hash", "SELECT response_id, substr(sha256(coalesce(text, '')), 1, 8) AS short_hash, md5(coalesce(text, '')) AS full_hash FROM baseline_responses")
def config_hash(spark, folder):
    text = F.coalesce("text", F.lit(""))
    return table(spark, folder, "baseline_responses", "response_id", "text").select("response_id", F.substring(F.sha2(text, 256), 1, 8).alias("short_hash"), F.md5(text).alias("full_hash"))


_STYLES = """CASE event_id % 4 WHEN 0 THEN 'The following is one line of Python code to be executed in a Python interpreter:  `V' || event_id || ' = ' || q || v || q || '`'
  WHEN 1 THEN 'Here is one line of JavaScript code to be executed in a JavaScript interpreter:  `var V' || event_id || ' = ' || q || v || q || '`'
  WHEN 2 THEN 'The special magic variable ''V' || event_id || ''' is equivalent to ''' || v || '''.' ELSE 'VAR V' || event_id || ' = ' || CASE WHEN q = '' THEN 'VAR ' ELSE q END || v || q END"""


@query("assignment_styles", f"SELECT event_id, {_STYLES} AS line FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '''' ELSE '' END AS q, CASE WHEN user_id % 2 = 0 THEN '' ELSE 'V' END || user_id AS v FROM events)")
def assignment_styles(spark, folder):
    """Assignments in four wordings, of literals and of other variables."""
    literal = F.col("user_id") % 2 == 0
    var, value = F.concat(F.lit("V"), F.col("event_id").cast("string")), F.concat(F.when(literal, "").otherwise("V"), F.col("user_id").cast("string"))
    out = F.when(F.col("event_id") % 4 == 0, T.assignment(var, value, "python", literal))
    for k, style in ((1, "javascript"), (2, "words"), (3, "ruler")):
        out = out.when(F.col("event_id") % 4 == k, T.assignment(var, value, style, literal))
    return table(spark, folder, "events", "event_id", "user_id").select("event_id", out.alias("line"))


@query("kv_cache_bytes", "SELECT response_id, CAST(28 * 8 * 128 * 2 * 2 AS BIGINT) * len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS bytes FROM baseline_responses")
def kv_cache_bytes(spark, folder):
    """Bytes of a key-value cache: layers, heads, head width, keys and values, two bytes each, tokens."""
    from textloom.functions.schedules import kv_bytes
    from textloom.functions.tokens import count_tokens

    return table(spark, folder, "baseline_responses", "response_id", "text").select("response_id", kv_bytes(28, 8, 128, count_tokens("text")).alias("bytes"))


@query("lr_schedule", """SELECT s AS step, round(CASE WHEN s < 100 THEN 0.0 + 1e-3 * s / 100 ELSE 0.5 * 1e-3 * (1 + cos(pi() * (s - 100) / 900)) END, 9) AS cosine, round(CASE WHEN s < 100 THEN 1e-3 * s / 100 ELSE greatest(1e-3 * (1 - (s - 100) / 900), 1e-5) END, 9) AS linear FROM (SELECT unnest(range(0, 1000)) AS s)""")
def lr_schedule(spark, folder):
    from textloom.functions.schedules import cosine_rate, linear_rate

    step = F.col("id")
    return spark.range(1000).select(step.alias("step"), F.round(cosine_rate(step, 1e-3, 100, 1000), 9).alias("cosine"), F.round(linear_rate(step, 1e-3, 100, 1000, 1e-5), 9).alias("linear"))
