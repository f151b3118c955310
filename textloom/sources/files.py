"""Sources of files: conversations, text corpora, tables kept as JSON, and listings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import between_markers, strip_latex_comments, visible_html

CONVERSATION = "conv_id long, messages array<struct<role:string,content:string,token_ids:array<int>,top_logprobs:struct<token_idx:array<int>,token_id:array<int>,logprobs:array<float>,shape:struct<tokens:int,k:int>>>>, system_prompt string, metadata string, type string"
#: Suffixes of a folder that are read as text unless others are named. Fixed values.
TEXT_SUFFIXES = (".txt", ".md", ".py", ".json", ".yaml", ".yml", ".html", ".tex")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of a Parquet path, with the declared schema (missing columns are null). Pickles are refused: loading one
    runs code."""
    if not str(path).rstrip("/").endswith(".parquet"):
        raise ValueError(f"conversations are read from .parquet, not {path}")
    return spark.read.schema(CONVERSATION).parquet(str(path))


def read_shards(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """All Parquet files under a folder, in the order of their names as ``ord``; unreadable ones are skipped; an empty folder is
    an error. ``limit`` keeps the first rows in that order."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").parquet(folder)
    rows = rows.withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))
    return rows.orderBy("ord").limit(limit) if limit is not None else rows


SOURCE_KINDS = ("local", "shards", "artifact")


def resolve_source(spark: SparkSession, source: str | dict) -> DataFrame:
    """Conversations of one source: a Parquet path, or ``{"path", "type", "limit"}``. Type ``local`` is one path, ``shards`` a dataset's
    folder of which only ``data/*.parquet`` is read, in the order of names, ``artifact`` a store's folder of versions
    ``name:version``. ``limit`` keeps the first rows."""
    spec = {"path": source} if isinstance(source, str) else dict(source)
    path, limit = spec["path"], spec.get("limit")
    kind = spec.get("type") or ("local" if path.rstrip("/").endswith(".parquet") else "artifact")
    if kind == "local":
        rows = read_conversations(spark, path).withColumn("ord", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))
        return rows.orderBy("ord").limit(limit) if limit is not None else rows
    if kind == "shards":
        return read_shards(spark, os.path.join(path, "data"), limit)
    if kind == "artifact":
        return read_shards(spark, artifact_version(path), limit)
    raise ValueError(f"source type must be one of {SOURCE_KINDS}, not {kind}")


def artifact_version(name: str) -> str:
    """The folder of ``root/artifact:version``: versions are kept as ``root/artifact/v0``, ``v1`` and on; ``:latest``, or no version, is the one of
    the highest number."""
    root, _, version = name.rpartition(":") if ":" in os.path.basename(name) else (name, "", "latest")
    if version != "latest":
        return os.path.join(root, version)
    numbers = [int(x[1:]) for x in os.listdir(root) if x[:1] == "v" and x[1:].isdigit()]
    if not numbers:
        raise FileNotFoundError(f"no version under {root}")
    return os.path.join(root, f"v{max(numbers)}")


def load_sources(spark: SparkSession, sources: list[str | dict]) -> DataFrame:
    """The sources one after the other, each cut to its own limit; ``source_no`` and ``ord`` keep the order."""
    return union_sources([resolve_source(spark, s) for s in sources])


def inline_text(spark: SparkSession, *texts: str) -> DataFrame:
    """(path, text): texts given in place."""
    return spark.createDataFrame([(f"inline-{i}", t) for i, t in enumerate(texts)], "path string, text string")


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Bag union by name; columns that a source lacks are null."""
    out = sources[0].withColumn("source_no", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source_no", F.lit(i)), allowMissingColumns=True)
    return out


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_directory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> DataFrame:
    """(name, text, context): a folder's own files with one of the suffixes, as UTF-8, else as Latin-1; ``context`` has the
    name before the text. Folders inside are not entered."""
    raw = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*")
    name = F.substring_index("path", "/", -1)
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.endswith(name, F.lit(s))
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    rows = raw.where(keep).select(name.alias("name"), text.alias("text"))
    return rows.withColumn("context", F.concat(F.lit("File: "), "name", F.lit("\n\n"), "text"))


def read_latex(spark: SparkSession, root: str) -> DataFrame:
    """(text): the .tex files under a folder in the order of their paths, without comments, each after a line that names it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    rel = F.regexp_replace("path", f"^(?:file:)?/*{base.lstrip('/')}", "")
    part = F.concat(F.lit("% Content from: "), rel, F.lit("\n"), strip_latex_comments(F.decode("content", "UTF-8")))
    parts = F.array_sort(F.collect_list(F.struct(rel.alias("p"), part.alias("t"))))
    return raw.agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("text"))


def read_json_tables(spark: SparkSession, path: str, columns: str, versions: str = "all") -> DataFrame:
    """Rows of tables kept as JSON ``{"columns": [...], "data": [[...]]}``, with the file as ``artifact``. ``columns``: DDL of
    the columns wanted, all cells read as strings and cast; columns that a table lacks are null. ``versions="latest"`` reads the file whose name is the last only."""
    if versions not in ("all", "latest"):
        raise ValueError("versions must be all or latest")
    if versions == "latest" and os.path.isdir(path):
        path = os.path.join(path, max(x for x in os.listdir(path) if x.endswith(".json")))
    raw = spark.read.schema("columns array<string>, data array<array<string>>").option("multiLine", "true").json(path)
    rows = raw.select(F.col("_metadata.file_name").alias("artifact"), "columns", F.explode("data").alias("cells"))
    wanted = spark.createDataFrame([], columns).schema
    cell = lambda f: F.get("cells", F.array_position("columns", f.name).cast("int") - 1).try_cast(f.dataType).alias(f.name)
    return rows.select("artifact", *[F.when(F.array_contains("columns", f.name), cell(f)).alias(f.name) for f in wanted])


def read_patients(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """(patient_id, question_id, question, answer) of a benchmark file: a JSON object of patients by id with their questions."""
    schema = "map<string,struct<name:string,texts:map<string,string>,questions:array<struct<No:int,question:string,correct:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("patient_id", "p"))
    rows = raw.where(F.col("patient_id").isin(ids)) if ids is not None else raw
    return rows.select("patient_id", F.explode("p.questions").alias("q")).select("patient_id", F.concat_ws("_", "patient_id", "q.No").alias("question_id"), "q.question", F.col("q.correct").alias("answer"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, folder, gb, relative): the Parquet files under a folder that are not empty, in the order of their paths below it; their contents are not read."""
    base = os.path.abspath(folder).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return raw.where("length > 0").select("path", F.substring_index("path", "/", -1).alias("name"), F.regexp_replace("path", "/[^/]+$", "").alias("folder"), (F.col("length") / 1e9).alias("gb"), F.regexp_replace("path", f"^(?:file:)?/*{base.lstrip('/')}", "").alias("relative")).orderBy("relative")


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows of a Parquet path, from its footers; none if it can't be read."""
    try:
        return spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001
        return None


def read_legacy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(pos, row): the rows of an old JSON dataset, as JSON texts: a list itself, or of an object the list under ``rows``, else ``examples``, else ``data``, else the
    first list of any name. Anything else has no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = "map_filter(try_variant_get(v, '$', 'map<string,variant>'), (k, x) -> startswith(schema_of_variant(x), 'ARRAY'))"
    named = raw.withColumn("m", F.expr(lists)).withColumn("own", F.expr("if(startswith(schema_of_variant(v), 'ARRAY'), v, null)"))
    first = "get(map_values(m), 0)"
    chosen = F.expr(f"coalesce(own, try_element_at(m, 'rows'), try_element_at(m, 'examples'), try_element_at(m, 'data'), {first})")
    rows = named.select(F.explode(F.expr("array(1)")), chosen.alias("l")).select(F.posexplode(F.try_variant_get("l", "$", "array<variant>")).alias("pos", "x"))
    return rows.select("pos", F.to_json("x").alias("row"))


def read_benchmark_sample(spark: SparkSession, path: str, sample_idx: int) -> DataFrame:
    """(context, query, answers): a benchmark file's sample of that number (JSON ``{"config", "samples": [{"context", "queries"}]}``), a row a query. A number
    beyond the samples is an error."""
    schema = "struct<samples:array<struct<context:string,queries:array<struct<query:string,answers:array<string>>>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema)["samples"].alias("s"))
    if (n := raw.select(F.max(F.size("s")).alias("n")).first()["n"] or 0) <= sample_idx:
        raise IndexError(f"{path} has {n} samples, none of number {sample_idx}")
    return raw.select(F.get("s", sample_idx).alias("x")).select("x.context", F.explode("x.queries").alias("q")).select("context", "q.query", "q.answers")


def config_beside(path: str, name: str = "config.yaml") -> str | None:
    """The configuration file beside a dataset, else in the folder above; none if there is neither."""
    here = os.path.dirname(path)
    for folder in (here, os.path.dirname(here)):
        if os.path.exists(os.path.join(folder, name)):
            return os.path.join(folder, name)
    return None


def read_examples(spark: SparkSession, path: str, schema: str, skip: int = 1, expect: int | None = None) -> DataFrame:
    """Elements of a JSON array file after the first ``skip``, with their position; another number than ``expect`` is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{schema}>").alias("a"))
    rows = raw.select(F.posexplode("a").alias("pos", "x")).where(F.col("pos") >= skip).select("pos", "x.*")
    if expect is not None and (n := rows.count()) != expect:
        raise ValueError(f"{path} has {n} examples, not {expect}")
    return rows


def load_source(spark: SparkSession, kind: str, path: str, start: str = "", end: str = "") -> DataFrame:
    """(path, text) of a source by kind: ``text``, ``page`` (its visible text) or ``section`` (what lies between two markers). A
    reader of PDF is not at hand; other kinds are refused."""
    rows = read_text(spark, path)
    if kind == "text":
        return rows
    if kind == "page":
        return rows.withColumn("text", visible_html("text"))
    if kind == "section":
        return rows.withColumn("text", between_markers("text", start, end))
    raise ValueError(f"no source of kind {kind}")
