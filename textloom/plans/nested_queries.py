"""Queries of problem 2: flat tables out of nested mail records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import nested
from textloom.plans.catalogue import query
from textloom.sources.tables import table


_UNWRAP = "CASE WHEN json_valid({0}) AND json_type({0}) = 'VARCHAR' THEN json_extract_string({0}, '$') ELSE {0} END"
_RECORDS = f"""WITH a AS (SELECT row_id, {_UNWRAP.format('raw')} AS raw FROM messages), b AS (SELECT row_id, {_UNWRAP.format('raw')} AS raw FROM a), c AS (SELECT row_id, {_UNWRAP.format('raw')} AS raw FROM b),
r AS (SELECT row_id, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM c), n AS (SELECT row_id, substr(t.fullkey, 3) AS path, t.value AS value FROM r, json_tree(r.j) t WHERE t.type = 'OBJECT' AND t.fullkey LIKE '%]')
"""


@query(
    "p2_found",
    _RECORDS + """SELECT 'messages' AS src, row_id AS rec_id, path, CASE WHEN regexp_matches(path, '^.*\\][^\\]]*\\[\\d+\\]$') THEN regexp_extract(path, '^(.*\\])[^\\]]*\\[\\d+\\]$', 1) ELSE '$' END AS parent_path FROM n
    UNION ALL SELECT 'threads', row_id, 'messages[' || (i - 1) || ']', '$' FROM threads, LATERAL (SELECT unnest(range(1, len(messages) + 1)) AS i) WHERE messages[i] IS NOT NULL""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each JSON object that is an element of an array: (src, rec_id, path, parent_path)."""
    mail = nested.with_variant(table(spark, folder, "messages", "row_id", "raw"), "raw", "record")
    threads = table(spark, folder, "threads", "row_id", "messages")
    out = ["row_id", "path", "parent_path"]
    return (
        nested.nodes(mail, "row_id", "record").select(F.lit("messages").alias("src"), *out)
        .unionByName(nested.array_nodes(threads, "row_id", "messages").select(F.lit("threads").alias("src"), *out))
        .withColumnRenamed("row_id", "rec_id")
    )


def _kind(kind: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = nested.flat_tables(table(spark, folder, "messages", "row_id", "raw"), "row_id", "raw")[kind].drop("node_key", "parent_key")
        return rows.withColumn("p", F.col("p").cast("double")) if kind == "votes" else rows

    run.__doc__ = f"The flat table of the records' {kind}."
    return run


_PARENT = "CASE WHEN regexp_matches(path, '^.*\\][^\\]]*\\[\\d+\\]$') THEN regexp_extract(path, '^(.*\\])[^\\]]*\\[\\d+\\]$', 1) ELSE '$' END AS parent_path"
query(
    "p2_table_headers",
    _RECORDS + f"SELECT row_id, path, {_PARENT}, CAST(regexp_extract(path, '(\\d+)\\]$', 1) AS INTEGER) AS ordinal, json_extract_string(value, '$.name') AS name, json_extract_string(value, '$.value') AS value FROM n WHERE regexp_matches(path, 'headers\\[\\d+\\]$')",
)(_kind("headers"))


def _kind_sql(kind: str, fields: dict[str, str]) -> str:
    columns = ", ".join(f"CAST(json_extract_string(value, '$.{path}') AS {'DOUBLE' if name == 'p' else 'VARCHAR'}) AS \"{name}\"" for name, path in fields.items())
    return _RECORDS + f"SELECT row_id, path, {_PARENT}, CAST(regexp_extract(path, '(\\d+)\\]$', 1) AS INTEGER) AS ordinal, {columns} FROM n WHERE regexp_matches(path, '(^|\\.){kind}\\[\\d+\\]$')"


#: The scalar fields of each kind of object, as column and path.
_FIELDS = {
    "parts": {"body_attachmentId": "body.attachmentId", "body_data": "body.data", "body_size": "body.size", "filename": "filename", "mimeType": "mimeType", "partId": "partId", "scan_engine_name": "scan.engine.name", "scan_engine_version": "scan.engine.version"},
    "hits": {"rule": "rule"}, "spans": {"from": "from", "to": "to"}, "votes": {"label": "label", "p": "p"},
}
for _name, _fields in _FIELDS.items():
    query(f"p2_table_{_name}", _kind_sql(_name, _fields))(_kind(_name))
_SCALAR = "CASE WHEN json_type(j, '$.{0}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(j, '$.{0}') END"
_TOP = {"historyId": "historyId", "id": "id", "internalDate": "internalDate", "payload_body_data": "payload.body.data", "payload_body_size": "payload.body.size", "payload_mimeType": "payload.mimeType", "payload_partId": "payload.partId", "payload_parts": "payload.parts",
        "payload_parts_body_data": "payload.parts.body.data", "payload_parts_body_size": "payload.parts.body.size", "payload_parts_mimeType": "payload.parts.mimeType", "payload_parts_partId": "payload.parts.partId", "sizeEstimate": "sizeEstimate", "threadId": "threadId"}
query("p2_table_records", _RECORDS + "SELECT row_id, '$' AS path, " + ", ".join(f"{_SCALAR.format(path)} AS {name}" for name, path in _TOP.items()) + " FROM r WHERE j IS NOT NULL")(_kind("$"))
query(
    "p2_table_labels",
    _RECORDS.rstrip() + f""", l AS (SELECT row_id, substr(t.fullkey, 3) AS path, t.value AS value FROM r, json_tree(r.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND regexp_matches(t.fullkey, '\\.labelIds\\[\\d+\\]$'))
    SELECT row_id, path, {_PARENT}, CAST(regexp_extract(path, '(\\d+)\\]$', 1) AS INTEGER) AS ordinal, json_extract_string(value, '$') AS value FROM l""",
)(_kind("labelIds"))


@query("p2_links", _RECORDS + f"SELECT regexp_extract(path, '([^.\\[]*)\\[\\d+\\]$', 1) AS kind, count(*) AS objects, CAST(sum(CASE WHEN parent_path = '$' THEN 1 ELSE 0 END) AS BIGINT) AS of_records, count(*) AS keys, CAST(0 AS BIGINT) AS lost FROM (SELECT path, {_PARENT} FROM n) GROUP BY kind")
def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """Objects of each kind, how many hang on the record itself, their distinct surrogate keys, and how many have a parent key that no object has."""
    mail = nested.with_variant(table(spark, folder, "messages", "row_id", "raw"), "raw", "record")
    rows = nested.nodes(mail, "row_id", "record").select("kind", "parent_path", "node_key", "parent_key")
    parents = rows.select(F.col("node_key").alias("parent_key"), F.lit(1).alias("__there"))
    joined = rows.join(parents, "parent_key", "left")
    lost = (F.col("parent_path") != "$") & F.col("__there").isNull()
    return joined.groupBy("kind").agg(
        F.count("*").alias("objects"), F.count(F.when(F.col("parent_path") == "$", 1)).alias("of_records"), F.count_distinct("node_key").alias("keys"), F.count(F.when(lost, 1)).alias("lost")
    )


@query(
    "p2_thread_messages",
    """SELECT row_id, 'messages[' || (i - 1) || ']' AS path, '$' AS parent_path, CAST(i - 1 AS INTEGER) AS ordinal,
       messages[i].id AS id, messages[i].subject AS subject, messages[i].from_address AS from_address,
       messages[i].date AS date
       FROM threads, LATERAL (SELECT unnest(range(1, len(messages) + 1)) AS i)
       WHERE messages[i] IS NOT NULL""",
)
def p2_thread_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The flat child table of ``threads.messages``."""
    rows = nested.array_nodes(table(spark, folder, "threads", "row_id", "messages"), "row_id", "messages")
    return rows.select("row_id", "path", "parent_path", "ordinal", "col.id", "col.subject", "col.from_address", "col.date")
