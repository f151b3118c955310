"""Queries on synthesis and benchmark generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.hashing import draw_sql
from textloom.functions.text import sentences
from textloom.operators import synthesis as S
from textloom.plans.catalogue import query
from textloom.sources.tables import table


@query("batch_plan", "SELECT i AS batch_id, CAST(least(32, 1000 - i * 32) AS INTEGER) AS size FROM (SELECT unnest(range(0, 32)) AS i)")
def batch_plan(spark, folder):
    return S.batch_plan(spark, 1000, 32)


@query("synth_mock_round")
def synth_mock_round(spark, folder):
    """Two-round self-study conversations on every paper's abstract by the mock model."""
    papers = table(spark, folder, "papers", "row_id", "abstract").where("abstract is not null")
    return S.self_study(papers, "row_id", "abstract", per_context=2, rounds=2, seed="study").select("row_id", "sample", "seed_type", "messages", "errors")


_SENT = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    "haystack_size_fit",
    f"""WITH s AS (SELECT doc_id, list_filter({_SENT}, lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, i, s[i] AS x FROM s, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
    c AS (SELECT doc_id, sum(len(regexp_extract_all(x, '\\S+'))) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM p) SELECT doc_id, count(*) AS sentences, CAST(max(cum) AS BIGINT) AS tokens FROM c WHERE cum + 64 <= 256 GROUP BY doc_id""",
)
def haystack_size_fit(spark, folder):
    rows = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(sentences("text")).alias("pos", "s"))
    return S.haystack_fit(rows, "doc_id", "pos", "s", 256, 64)


@query(
    "haystack_cycles",
    f"""WITH s AS (SELECT doc_id, list_filter({_SENT}, lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, i, len(regexp_extract_all(s[i], '\\S+')) AS t FROM s, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
    c AS (SELECT doc_id, sum(t) OVER (PARTITION BY doc_id ORDER BY i) AS cum, sum(t) OVER (PARTITION BY doc_id) AS a, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
    SELECT doc_id, CAST(any_value(3936 // a * n) + count(*) FILTER (cum <= 3936 % a) AS BIGINT) AS units, CAST(any_value(3936 // a) AS BIGINT) AS cycles, CAST(any_value(3936 // a * a) + coalesce(max(cum) FILTER (cum <= 3936 % a), 0) AS BIGINT) AS tokens FROM c WHERE a > 0 GROUP BY doc_id""",
)
def haystack_cycles(spark, folder):
    """The size of a haystack of each document's sentences, said again as often as 4,000 tokens hold, with 64 kept free."""
    rows = table(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(sentences("text")).alias("pos", "s"))
    return S.haystack_size(rows, "doc_id", "pos", "s", 4000, 64)


@query("haystack_shrink", """SELECT response_id, CASE WHEN t <= 512 THEN 40 WHEN 40 - CAST(ceil((t - 512) / 60.0) AS BIGINT) * 5 >= 5 THEN 40 - CAST(ceil((t - 512) / 60.0) AS BIGINT) * 5 END AS used FROM (SELECT response_id, 480 + len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS t FROM baseline_responses)""")
def haystack_shrink(spark, folder):
    """Samples of 40 units of 12 tokens with an answer's tokens on top, taken back by 5 units until they fit in 512."""
    from textloom.functions.tokens import count_tokens

    rows = table(spark, folder, "baseline_responses", "response_id", "text").select("response_id", F.lit(40).alias("n"), (F.lit(480) + count_tokens("text")).alias("t"))
    return S.shrink_to_fit(rows, "n", "t", 512, F.lit(12), 5).select("response_id", "used")


@query("needle_positions", f"""WITH n AS (SELECT unnest(range(0, 24)) AS needle), d AS (SELECT needle, round(({draw_sql('niah', "'depth'", 'needle')} % 512) * 100 / 511.0) AS depth FROM n) SELECT needle, CAST(floor(1000 * depth / 100) AS INTEGER) AS place FROM d""")
def needle_positions(spark, folder):
    from textloom.functions.hashing import draw

    places = S.depth_points(1000)
    at = F.element_at(F.array(*map(F.lit, places)), (draw("niah", F.lit("depth"), "needle") % len(places) + 1).cast("int"))
    return S.needles(spark, 12, 2, "niah").select("needle", at.alias("place"))


_ESSAY = f"""WITH d AS (SELECT doc_id, list_filter({_SENT}, lambda x: trim(x) <> '') AS s FROM documents WHERE source = 'essay' AND text IS NOT NULL), p AS (SELECT s[i] AS text, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM d, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)), c AS (SELECT count(*) AS n FROM p),
h AS (SELECT needle, needle // 2 AS k, round(({draw_sql('niah', "'depth'", 'needle')} % 512) * 100 / 511.0) AS depth FROM (SELECT unnest(range(0, 24)) AS needle)),
v AS (SELECT needle, depth, 'One of the special magic numbers for key-' || lpad(CAST({draw_sql('niah', "'key'", 'k')} % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(k AS VARCHAR), 4, '0') || ' is: ' || (1000000 + {draw_sql('niah', "'value'", 'needle')} % 9000000) || '.' AS text FROM h)
"""


@query("needle_haystack", _ESSAY + """SELECT lpad(CAST(2 * pos + 1 AS VARCHAR), 12, '0') || '.000000' AS ord, text FROM p
UNION ALL SELECT lpad(CAST(2 * CAST(floor(n * depth / 100) AS BIGINT) AS VARCHAR), 12, '0') || '.' || lpad(CAST(needle AS VARCHAR), 6, '0'), text FROM v, c""")
def needle_haystack(spark, folder):
    """A haystack of the sentences of the essays, in order, with 24 needles."""
    rows = table(spark, folder, "documents", "doc_id", "source", "text").where("source = 'essay' and text is not null").select("doc_id", F.posexplode(sentences("text")).alias("p", "s"))
    rows, n = S.numbered(rows, ["doc_id", "p"], "pos")
    return S.hide_needles(rows, "pos", "s", S.needles(spark, 12, 2, "niah"), n, "niah")


@query("needle_queries", f"""WITH n AS (SELECT needle, needle // 2 AS k FROM (SELECT unnest(range(0, 24)) AS needle)), v AS (SELECT needle, 'key-' || lpad(CAST({draw_sql('niah', "'key'", 'k')} % 100000 AS VARCHAR), 5, '0') || '-' || lpad(CAST(k AS VARCHAR), 4, '0') AS key, CAST(1000000 + {draw_sql('niah', "'value'", 'needle')} % 9000000 AS VARCHAR) AS value FROM n)
SELECT key, 'What are all the special magic numbers for ' || key || '?' AS question, list(value ORDER BY needle) AS answers FROM v GROUP BY key""")
def needle_queries(spark, folder):
    return S.needle_queries(S.needles(spark, 12, 2, "niah"))


_CHAIN = f"""WITH RECURSIVE r AS (SELECT unnest(range(0, 300)) AS id), n AS (SELECT id, id // 5 AS chain, id % 5 AS hop, upper(translate(substr(md5('vt' || id), 1, 5), '0123456789', 'GHIJKLMNOP') || id) AS var, upper(translate(substr(md5('vt' || (id - 1)), 1, 5), '0123456789', 'GHIJKLMNOP') || (id - 1)) AS source FROM r),
e AS (SELECT var, CASE WHEN hop > 0 THEN source END AS source, CAST(10000 + {draw_sql('vt', "'literal'", 'chain')} % 90000 AS VARCHAR) AS literal FROM n), c AS (SELECT var, literal AS value FROM e WHERE source IS NULL UNION ALL SELECT e.var, c.value FROM c JOIN e ON e.source = c.var)
"""


@query("chain_closure", _CHAIN + "SELECT value, list(var ORDER BY var) AS vars FROM c GROUP BY value")
def chain_closure(spark, folder):
    """All variables that come to a value, through up to four aliases."""
    rows = S.resolve_chains(S.variable_chains(spark, 60, 4, "vt"), 4)
    return rows.groupBy("value").agg(F.array_sort(F.collect_list("var")).alias("vars"))


@query("chain_lines", f"""WITH n AS (SELECT id, id // 5 AS chain, id % 5 AS hop, upper(translate(substr(md5('vt' || id), 1, 5), '0123456789', 'GHIJKLMNOP') || id) AS var, upper(translate(substr(md5('vt' || (id - 1)), 1, 5), '0123456789', 'GHIJKLMNOP') || (id - 1)) AS source FROM (SELECT unnest(range(0, 300)) AS id)),
u AS (SELECT chain, list_sort(list({draw_sql('vt', "'mix'", 'chain', 'hop')})) AS u FROM n GROUP BY chain)
SELECT chain, hop, 'VAR ' || var || ' = ' || CASE WHEN hop > 0 THEN 'VAR ' || source ELSE '''' || CAST(10000 + {draw_sql('vt', "'literal'", 'chain')} % 90000 AS VARCHAR) || '''' END AS line, u[hop + 1] AS priority FROM n JOIN u USING (chain)""")
def chain_lines(spark, folder):
    """The assignments of all chains in one drawn order that keeps each chain's own."""
    return S.variable_chains(spark, 60, 4, "vt").select("chain", "hop", "line", "priority")
