"""Queries on sampling and date buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions.hashing import draw, draw_sql
from textloom.operators import buckets as B
from textloom.operators import sampling as S
from textloom.plans.catalogue import query
from textloom.sources.tables import table

_START, _END, _DAYS, _NOW = "2024-01-01", "2024-01-31", 7, "2024-01-31"


@query("sample_without_replacement", f"SELECT doc_id FROM documents ORDER BY {draw_sql('swr', 'doc_id')}, doc_id LIMIT 256")
def sample_without_replacement(spark, folder):
    return S.without_replacement(table(spark, folder, "documents", "doc_id"), "doc_id", 256, "swr")


@query("sample_by_group", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {draw_sql('grp', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 5")
def sample_by_group(spark, folder):
    return S.without_replacement(table(spark, folder, "documents", "source", "doc_id"), "doc_id", 5, "grp", "source")


@query("choose_one_by_group", f"SELECT source, arg_min(doc_id, {{'u': {draw_sql('one', 'doc_id')}, 'k': doc_id}}) AS doc_id FROM documents GROUP BY source")
def choose_one_by_group(spark, folder):
    docs = table(spark, folder, "documents", "source", "doc_id")
    return S.choose_one(docs.withColumn("k", F.col("doc_id")), "source", "k", "one", "doc_id")


_PROMPTS = ["structuring", "summarization", "question", "use_case", "creative", "generic"]


@query("sample_with_replacement", f"SELECT doc_id, {_PROMPTS}[{draw_sql('seedtype', 'doc_id')} % 6 + 1] AS choice FROM documents")
def sample_with_replacement(spark, folder):
    """A seed type drawn for each document."""
    return S.with_replacement(_PROMPTS, table(spark, folder, "documents", "doc_id"), "doc_id", "seedtype")


@query("seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {draw_sql('ep-0', 'doc_id')}, doc_id) - 1 AS position, CAST((row_number() OVER (ORDER BY {draw_sql('ep-0', 'doc_id')}, doc_id) - 1) % 4 AS INTEGER) AS rank FROM documents")
def seeded_shuffle(spark, folder):
    return S.epoch_shards(table(spark, folder, "documents", "doc_id"), "doc_id", "ep", 0, 4)


@query("bernoulli_flags", f"SELECT count(*) AS n, CAST(sum(CASE WHEN {draw_sql('think', 'doc_id')} / 4294967296.0 < 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM documents")
def bernoulli_flags(spark, folder):
    from textloom.functions.hashing import unit

    return table(spark, folder, "documents", "doc_id").agg(F.count("*").alias("n"), F.sum((unit("think", "doc_id") < 0.3).cast("long")).alias("flagged"))


@query("interleave_lists", f"WITH l AS (SELECT source, doc_id, {draw_sql('mix', 'source', 'doc_id')} AS u FROM documents WHERE source IS NOT NULL), a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM l), b AS (SELECT source, u, row_number() OVER (PARTITION BY source ORDER BY u, doc_id) AS n FROM l) SELECT a.source, a.doc_id, b.u AS priority FROM a JOIN b ON a.source = b.source AND a.n = b.n")
def interleave_lists(spark, folder):
    return S.interleave(table(spark, folder, "documents", "source", "doc_id").where("source is not null"), "source", "doc_id", "mix")


@query(
    "weighted_label_sample",
    f"""WITH w AS (SELECT label, sum(weight) AS weight FROM threads WHERE label IS NOT NULL AND weight > 0 GROUP BY label),
    r AS (SELECT label, sum(weight) OVER (ORDER BY label) / sum(weight) OVER () AS hi, lag(weight, 1, 0) OVER (ORDER BY label) AS x, (sum(weight) OVER (ORDER BY label) - weight) / sum(weight) OVER () AS lo FROM w),
    d AS (SELECT doc_id, {draw_sql('label', 'doc_id')} / 4294967296.0 AS u FROM documents) SELECT d.doc_id, r.label FROM d JOIN r ON d.u >= r.lo AND d.u < r.hi""",
)
def weighted_label_sample(spark, folder):
    """A mail label drawn by weight for each document."""
    w = table(spark, folder, "threads", "label", "weight").where("label is not null and weight > 0").groupBy("label").agg(F.sum("weight").alias("weight"))
    return S.weighted_choice(w, "label", "weight", table(spark, folder, "documents", "doc_id"), "doc_id", "label")


_BUCKET = f"""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events), b AS (SELECT event_type, strftime(DATE '{_START}' + CAST(((d - DATE '{_START}') // {_DAYS}) * {_DAYS} AS INTEGER), '%Y-%m-%d') || '_to_' ||
strftime(least(DATE '{_START}' + CAST(((d - DATE '{_START}') // {_DAYS}) * {_DAYS} + {_DAYS} AS INTEGER), DATE '{_END}'), '%Y-%m-%d') AS bucket FROM e WHERE d >= DATE '{_START}' AND d < DATE '{_END}')
"""


def _bucketed(spark, folder):
    day = F.to_date("ts")
    e = table(spark, folder, "events", "event_type", "ts")
    return e.select("event_type", B.bucket_name(day, _START, _END, _DAYS).alias("bucket")).where("bucket is not null")


@query("date_bucket_counts", _BUCKET + "SELECT event_type, bucket, count(*) AS n FROM b GROUP BY ROLLUP (event_type, bucket)")
def date_bucket_counts(spark, folder):
    """Events by label and bucket, with the totals of each label and of all."""
    return _bucketed(spark, folder).rollup("event_type", "bucket").agg(F.count("*").alias("n"))


_WEIGHTS = _BUCKET + f", n AS (SELECT event_type, bucket, count(*) AS n FROM b GROUP BY ALL), w AS (SELECT event_type, bucket, n, greatest(DATE '{_NOW}' - CAST(split_part(bucket, '_to_', 2) AS DATE), 0) AS age FROM n), r AS (SELECT event_type, bucket, age, exp(-ln(2.0) * age / 14.0) * pow(n, 0.3) AS weight FROM w)\n"


def _weights(spark, folder):
    n = _bucketed(spark, folder).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))
    return n.select("event_type", "bucket", B.age_days(F.col("bucket"), _NOW).alias("age"), B.recency_weight(F.col("bucket"), F.col("n"), _NOW, 14.0).alias("weight"))


@query("recency_weights", _WEIGHTS + "SELECT event_type, bucket, CAST(age AS INTEGER) AS age, round(weight, 6) AS weight FROM r")
def recency_weights(spark, folder):
    return _weights(spark, folder).withColumn("weight", F.round("weight", 6))


@query(
    "recency_weighted_sample",
    _WEIGHTS + f""", t AS (SELECT event_type || '/' || bucket AS option, weight FROM r), c AS (SELECT option, (sum(weight) OVER (ORDER BY option) - weight) / sum(weight) OVER () AS lo, sum(weight) OVER (ORDER BY option) / sum(weight) OVER () AS hi FROM t),
    d AS (SELECT doc_id, {draw_sql('bucket', 'doc_id')} / 4294967296.0 AS u FROM documents) SELECT option, count(*) AS n FROM d JOIN c ON u >= lo AND u < hi GROUP BY option""",
)
def recency_weighted_sample(spark, folder):
    """How often each label and bucket is drawn by recency and size."""
    w = _weights(spark, folder).select(F.concat_ws("/", "event_type", "bucket").alias("option"), "weight")
    return S.weighted_choice(w, "option", "weight", table(spark, folder, "documents", "doc_id"), "doc_id", "bucket").groupBy("option").agg(F.count("*").alias("n"))


@query("label_bucket_grid", f"SELECT l.event_type, strftime(d, '%Y-%m-%d') AS start FROM (SELECT DISTINCT event_type FROM events) l, (SELECT unnest(generate_series(DATE '{_START}', DATE '{_END}' - 1, INTERVAL {_DAYS} DAY)) AS d)")
def label_bucket_grid(spark, folder):
    """Every label with every bucket: the partitions of a mail scan. Both sides are small by nature."""
    labels = table(spark, folder, "events", "event_type").distinct()
    grid = B.buckets(spark, _START, _END, _DAYS).select(F.date_format("start", "yyyy-MM-dd").alias("start"))
    return labels.crossJoin(F.broadcast(grid))


@query("section_subset", f"WITH s AS (SELECT row_id, CAST(i - 1 AS INTEGER) AS pos, len(sections) AS n FROM papers, LATERAL (SELECT unnest(range(1, len(sections) + 1)) AS i)), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY {draw_sql('sec', 'row_id', 'pos')}, pos) AS r, 1 + {draw_sql('secn', 'row_id')} % n AS want FROM s) SELECT row_id, pos FROM k WHERE r <= want")
def section_subset(spark, folder):
    """A drawn number of sections of each paper, drawn without replacement."""
    from pyspark.sql.window import Window

    s = table(spark, folder, "papers", "row_id", "sections").select("row_id", F.size("sections").alias("n"), F.posexplode("sections").alias("pos", "x")).drop("x")
    r = F.row_number().over(Window.partitionBy("row_id").orderBy(draw("sec", "row_id", "pos"), "pos"))
    return s.withColumn("r", r).where(F.col("r") <= 1 + draw("secn", "row_id") % F.col("n")).select("row_id", "pos")
