"""Queries of the llm problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import leak, mail, mix, pack, pairs, pii, split, toxic
from textloom.llm.tokens import n_tokens
from textloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def limit_of(spark: SparkSession, folder: str, item_type: str) -> tuple[int, int]:
    """(max_size, overlap) of an item type; the table has one row a type."""
    r = table(spark, folder, "size_limits").where(F.col("item_type") == item_type).first()
    return r["max_size"], r["overlap"]


# ---------------------------------------------------------------- 1: oversized items


def _items(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three item types as (item_type, rec_id, section_pos, paragraph_pos, text)."""
    key = lambda kind, rec, s, p: (F.lit(kind).alias("item_type"), F.col(rec).alias("rec_id"), s.cast("long").alias("section_pos"), p.cast("long").alias("paragraph_pos"))
    none = F.lit(-1)
    sections = table(spark, folder, "papers", "row_id", "sections").select("row_id", F.posexplode("sections").alias("s", "section")).where("section is not null")
    paragraphs = sections.select("row_id", "s", F.posexplode("section.paragraphs").alias("p", "text"))
    return {
        "message": table(spark, folder, "messages", "row_id", "content").select(*key("message", "row_id", none, none), F.col("content").alias("text")),
        "section": sections.select(*key("section", "row_id", F.col("s"), none), F.array_join("section.paragraphs", "\n\n").alias("text")),
        "paragraph": paragraphs.select(*key("paragraph", "row_id", F.col("s"), F.col("p")), "text"),
    }


def _pieces(spark: SparkSession, folder: str, only_oversized: bool) -> DataFrame:
    parts = [split.split_items(df, "text", *limit_of(spark, folder, kind), only_oversized=only_oversized) for kind, df in _items(spark, folder).items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "p1_found",
    """WITH lim AS (SELECT item_type, max_size FROM size_limits), sec AS (SELECT row_id, i - 1 AS s, sections[i] AS x FROM papers, LATERAL (SELECT unnest(range(1, len(sections) + 1)) AS i) WHERE sections[i] IS NOT NULL),
    par AS (SELECT row_id, s, j - 1 AS p, x.paragraphs[j] AS t FROM sec, LATERAL (SELECT unnest(range(1, len(x.paragraphs) + 1)) AS j)),
    item AS (SELECT 'message' AS item_type, row_id AS rec_id, -1 AS section_pos, -1 AS paragraph_pos, length(content) AS n FROM messages UNION ALL SELECT 'paragraph', row_id, s, p, length(t) FROM par
    UNION ALL SELECT 'section', row_id, s, -1, length(array_to_string(list_filter(x.paragraphs, lambda p: p IS NOT NULL), chr(10) || chr(10))) FROM sec)
    SELECT item_type, rec_id, CAST(section_pos AS BIGINT) AS section_pos, CAST(paragraph_pos AS BIGINT) AS paragraph_pos FROM item JOIN lim USING (item_type) WHERE n > max_size""",
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items longer than their limit: those that come out in more than one piece."""
    return _pieces(spark, folder, True).where("piece_no = 1").select("item_type", "rec_id", "section_pos", "paragraph_pos")


@query("p1_pieces")
def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every item, those within the limit as they are."""
    return _pieces(spark, folder, False).select("item_type", "rec_id", "section_pos", "paragraph_pos", "piece_no", "overlap", "piece")


@query(
    "p1_rejoined",
    """WITH sec AS (SELECT row_id, unnest(sections) AS x FROM papers), it AS (SELECT 'message' AS item_type, content AS t FROM messages UNION ALL SELECT 'section', array_to_string(list_filter(x.paragraphs, lambda p: p IS NOT NULL), chr(10) || chr(10)) FROM sec WHERE x IS NOT NULL
    UNION ALL SELECT 'paragraph', unnest(x.paragraphs) FROM sec WHERE x IS NOT NULL)
    SELECT item_type, count(*) AS items, CAST(sum(length(t)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_overlaps, CAST(0 AS BIGINT) AS unlike FROM it WHERE t IS NOT NULL GROUP BY item_type""",
)
def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Of each item type: items and characters that its pieces give without their overlaps, pieces above the limit, second and later
    pieces whose overlap is not the one asked for, and items whose pieces put together are not the text."""
    parts = []
    for kind, df in _items(spark, folder).items():
        size, overlap = limit_of(spark, folder, kind)
        whole = df.withColumn("whole", F.xxhash64("text"))
        rows = split.split_items(whole, "text", size, overlap)
        own = F.substr("piece", F.col("overlap") + 1)
        items = rows.groupBy("item_type", "rec_id", "section_pos", "paragraph_pos", "whole").agg(
            F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("pieces"),
            F.count(F.when(F.length("piece") > size, 1)).alias("too_long"), F.count(F.when((F.col("piece_no") > 0) & (F.col("overlap") != overlap), 1)).alias("wrong"),
        )  # one item's pieces
        text = F.array_join(F.transform("pieces", lambda x: x["own"]), "")
        parts.append(items.withColumn("joined", text).groupBy("item_type").agg(
            F.count("*").alias("items"), F.sum(F.length("joined")).alias("characters"), F.sum("too_long").alias("too_long"), F.sum("wrong").alias("wrong_overlaps"), F.count(F.when(F.xxhash64("joined") != F.col("whole"), 1)).alias("unlike"),
        ))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- 3: personal information


def _mail(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages", "row_id", "content", "from_address", "to_addresses")


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct mention of personal information."""
    return pii.mentions(_mail(spark, folder))


@query("p3_redacted")
def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The messages with a typed placeholder for each mention."""
    return pii.redacted(_mail(spark, folder))


# ---------------------------------------------------------------- 4: broken pairs


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "qasper_pairs", "pair_id", "question", "answer")
    answered = table(spark, folder, "baseline_responses", "response_id", "prompt_messages", "text")
    last = F.get("prompt_messages", F.size("prompt_messages") - 1)["content"]
    return asked.select(F.lit("qasper_pairs").alias("src"), F.col("pair_id").alias("rec_id"), F.col("question").alias("prompt"), "answer").unionByName(
        answered.select(F.lit("baseline_responses").alias("src"), F.col("response_id").alias("rec_id"), last.alias("prompt"), F.col("text").alias("answer"))
    )


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each defective pair with its defect."""
    both = _pairs(spark, folder)
    texts = both.select(F.explode(F.array("prompt", "answer")).alias("text")).where("text is not null")
    return pairs.defects(both, ["src", "rec_id"], "prompt", "answer", texts, "text")


@query("p4_rates")
def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Number of pairs of each source and defect."""
    return p4_found(spark, folder).groupBy("src", "defect").agg(F.count("*").alias("pairs"))


# ---------------------------------------------------------------- 5: quoted history and signatures


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "messages", "row_id", "content", "from_address", "snippet")
    return mail.label_mail(rows, "row_id", "content", "from_address", "snippet")


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each line that the sender did not newly write, and each snippet that shows a part of one."""
    return _labelled(spark, folder).where("label <> 'new'").select("row_id", "field", "line_no")


@query("p5_lines")
def p5_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-blank line with its label."""
    return _labelled(spark, folder)


@query("p5_new_text")
def p5_new_text(spark: SparkSession, folder: str) -> DataFrame:
    """Of each message only what was newly written."""
    return mail.new_text(table(spark, folder, "messages", "row_id", "content", "from_address"), ["row_id"], "content", "from_address")


@query("p5_thread_new_text")
def p5_thread_new_text(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the bodies in ``threads.messages``, by their position; null elements have no row."""
    rows = table(spark, folder, "threads", "row_id", "messages").select("row_id", F.posexplode("messages").alias("message_pos", "m")).where("m is not null")
    rows = rows.select("row_id", "message_pos", "m.content", "m.from_address")
    return mail.new_text(rows, ["row_id", "message_pos"], "content", "from_address")


# ---------------------------------------------------------------- 6: evaluation texts in the corpus


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items", "item_id", "question", "answer")
    read = {"messages": ("row_id", ["content"]), "qasper_pairs": ("pair_id", ["question", "answer"]), "documents": ("doc_id", ["text"])}
    found = [
        leak.leaks(table(spark, folder, name, key, *texts), [key], texts, items, "item_id", ["question", "answer"])
        .select(F.lit(name).alias("src"), F.col(key).alias("rec_id"), "item_id", "windows")
        for name, (key, texts) in read.items()
    ]
    return reduce(DataFrame.unionByName, found)


_WORDS = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
_LEAKS = f"""WITH t AS (SELECT 'messages' AS src, row_id AS rec_id, {_WORDS('content')} AS w FROM messages UNION ALL SELECT 'qasper_pairs', pair_id, {_WORDS('question')} FROM qasper_pairs
UNION ALL SELECT 'qasper_pairs', pair_id, {_WORDS('answer')} FROM qasper_pairs UNION ALL SELECT 'documents', doc_id, {_WORDS('text')} FROM documents),
e AS (SELECT item_id, {_WORDS('question')} AS w FROM eval_items UNION ALL SELECT item_id, {_WORDS('answer')} FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM e, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
c AS (SELECT src, rec_id, array_to_string(w[i:i + 7], ' ') AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8)
"""


@query("p6_found", _LEAKS + "SELECT DISTINCT src, rec_id, item_id FROM c JOIN g USING (g)")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each record and evaluation item that share eight or more consecutive words. A scan gives each pair once."""
    return _leaks(spark, folder).select("src", "rec_id", "item_id")


@query("p6_items", _LEAKS + ", k AS (SELECT src, rec_id, item_id, count(*) AS windows FROM c JOIN g USING (g) GROUP BY ALL) SELECT item_id, src, count(*) AS records, CAST(sum(windows) AS BIGINT) AS windows FROM k GROUP BY item_id, src")
def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Of each evaluation item, in how many records of each source it leaks; items that don't have no row."""
    return _leaks(spark, folder).groupBy("item_id", "src").agg(F.count("*").alias("records"), F.sum("windows").alias("windows"))


@query("p6_clean_documents")
def p6_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` without the leaked spans."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return leak.remove_leaks(docs, "text", table(spark, folder, "eval_items", "question", "answer"), ["question", "answer"])


# ---------------------------------------------------------------- 7: containers


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    capacity, _ = limit_of(spark, folder, "container")
    docs = table(spark, folder, "documents", "doc_id", "text").select("doc_id", n_tokens("text").alias("size"))
    return pack.fill_containers(docs, "doc_id", "size", capacity)


@query("p7_found", "SELECT doc_id FROM documents, size_limits WHERE item_type = 'container' AND len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+')) > max_size")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be divided: more tokens than a container holds."""
    return _containers(spark, folder).where("part_no = 1").select("doc_id")


@query("p7_assigned")
def p7_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every document with its container."""
    return _containers(spark, folder)


@query("p7_fill")
def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, tokens placed, the least number possible by size alone, and the share filled."""
    capacity, _ = limit_of(spark, folder, "container")
    each = _containers(spark, folder).where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return each.agg(
        F.count("*").alias("containers"), F.sum("n").alias("parts"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"),
        F.ceil(F.sum("t") / capacity).alias("least_containers"), F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("filled"),
    )


_SIZES = "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}\\x1c-\\x1f\\x85]+')) AS BIGINT) AS n, max_size FROM documents, size_limits WHERE item_type = 'container'"


@query("p7_placed", f"SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n > max_size) AS divided, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS gaps, TRUE AS tight FROM ({_SIZES})")
def p7_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens placed, documents divided, containers above their capacity, documents whose parts leave a gap, and whether
    the containers are at most two percent and one more than the tokens need."""
    capacity, _ = limit_of(spark, folder, "container")
    rows = _containers(spark, folder)
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("t"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    full = rows.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count("*").alias("containers"), F.count(F.when(F.col("t") > capacity, 1)).alias("overfull"))
    sums = docs.agg(F.count("*").alias("documents"), F.sum("t").alias("tokens"), F.count(F.when(F.col("parts") > 1, 1)).alias("divided"), F.count(F.when(F.col("t") != F.col("end"), 1)).alias("gaps"))
    tight = F.col("containers") <= F.ceil(F.col("tokens") / capacity) * 1.02 + 1
    return sums.crossJoin(full).select("documents", "tokens", "divided", "overfull", "gaps", tight.alias("tight"))  # one row each


# ---------------------------------------------------------------- 8: mixing sources


def _targets(spark: SparkSession, folder: str) -> dict[str, tuple[float, int]]:
    """source_targets has one row a source."""
    return {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in table(spark, folder, "source_targets").collect() if r["source"] is not None}


def _selection(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text").withColumn("n_tokens", n_tokens("text"))
    return mix.mix_sources(docs, "doc_id", "text", "source", "n_tokens", _targets(spark, folder))


@query("p8_selection")
def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The texts selected and how often each is used."""
    return _selection(spark, folder)


@query("p8_shares")
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix.shares(_selection(spark, folder), _targets(spark, folder))


@query("p8_repeats", "SELECT source, FALSE AS too_often FROM source_targets WHERE source IS NOT NULL")
def p8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source whether a text is used more often than it may be."""
    return p8_shares(spark, folder).select("source", (F.col("most_uses") > F.col("max_repeats")).alias("too_often"))


# ---------------------------------------------------------------- 9: abusive, hateful and sexual content


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxic.score_documents(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


@query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document and kind of language that it contains."""
    return toxic.found(_scores(spark, folder), "doc_id")


@query("p9_scores")
def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of every document."""
    return _scores(spark, folder)


@query("p9_source_rates")
def p9_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each source's documents with each kind; rows without a source form a group of their own."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    both = _scores(spark, folder).join(docs.select("doc_id", "source"), "doc_id")
    rate = lambda k: F.round(F.avg((F.col(k) >= toxic.THRESHOLD).cast("double")), 6).alias(k)
    return both.groupBy("source").agg(F.count("*").alias("documents"), *map(rate, toxic.KINDS))
