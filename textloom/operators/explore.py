"""Exploring datasets and runs: search, pages, neighbours, retention, nested values as paths."""

from __future__ import annotations

import json as _json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import nested


def search(df: DataFrame, text: str, messages: str | None = None, system: str | None = None, metadata: str | None = None) -> DataFrame:
    """Rows that hold the text, whatever its case, in one of the named columns: an array of structs with content, a string, a
    map of strings. The text is trimmed; a blank one keeps all rows; no named column keeps none."""
    want = text.strip().lower()
    if not want:
        return df
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(want)), F.lit(False))
    tests: list[Column] = []
    if messages:
        tests.append(F.coalesce(F.exists(messages, lambda m: has(m["content"])), F.lit(False)))
    if system:
        tests.append(has(F.col(system)))
    if metadata:
        tests.append(F.coalesce(F.exists(F.map_values(metadata), has), F.lit(False)))
    hit = F.lit(False)
    for t in tests:
        hit = hit | t
    return df.where(hit)


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Rows of a page from 0; a page beyond the end is empty. The order must be total."""
    return df.orderBy(*order).offset(number * size).limit(size)


def neighbours(df: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """Adds the keys before and after each row, within its group if one is named (else the keys are ranged in one place:
    meant for a page or a dataset of bounded size)."""
    w = Window.partitionBy(*([group] if group else [])).orderBy(order)
    return df.withColumn("prev", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def last_at_step(history: DataFrame, run: str, order: str) -> DataFrame:
    """The last row of each run."""
    return history.groupBy(run).agg(F.max_by(F.struct(*[c for c in history.columns if c != run]), order).alias("r")).select(run, "r.*")


def retention(files: DataFrame, path: str, keep: int) -> DataFrame:
    """(path, step, delete): checkpoints by the number in names cache-step10.pt or cache-epoch3.pt, all but the ``keep`` newest of
    a folder to be deleted; other files are left out."""
    pattern = r"^(.*/)?cache-(?:step|epoch)_?(\d+)\.pt$"
    rows = files.where(F.col(path).rlike(pattern)).select(path, F.regexp_extract(path, pattern, 1).alias("folder"), F.regexp_extract(path, pattern, 2).cast("long").alias("step"))
    w = Window.partitionBy("folder").orderBy(F.desc("step"), path)
    return rows.withColumn("delete", F.row_number().over(w) > keep).drop("folder")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one aggregate over all columns."""
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if n[f"c{i}"]])


def serve(df: DataFrame) -> DataFrame:
    """Every column as a string, nulls as empty ones."""
    flat = [F.coalesce(F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name) for f in df.schema]
    return df.select(*flat)


def is_conversation(json: Column | str) -> Column:
    """Whether a JSON text is a list of at least one object, all with role and content."""
    items = F.from_json(json, "array<struct<role:string,content:string>>")
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def leaf_paths(df: DataFrame, key: str, json: str, depth: int | None = None) -> DataFrame:
    """(key, path, value) of every leaf of a JSON text, path segments joined by ``/``; a JSON null has the value None, true and false
    are True and False. Empty containers and unparsable texts have no leaves. Without ``depth`` the texts are read once for the depth of
    their merged schema; with it, values nested deeper come out as JSON. The levels are opened one after the other in one stage."""
    rows = df.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    if depth is None:
        deep = lambda n: max([0, *(1 + deep(c) for c in n.fields.values()), *([1 + deep(n.element)] if n.element else [])])
        levels = deep(nested.infer(rows, "v"))
    else:
        levels = depth
    step = "concat(path, if(path = '', '', '/'), {})"
    kind = F.coalesce(F.schema_of_variant("v"), F.lit("VOID"))
    for _ in range(levels):
        rows = rows.withColumn("kind", kind).select(key, F.expr(f"""inline(case
            when startswith(kind, 'OBJECT') then transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), e -> struct({step.format('e.key')} as path, e.value as v))
            when startswith(kind, 'ARRAY') then transform(try_variant_get(v, '$', 'array<variant>'), (x, i) -> struct({step.format('i')} as path, x as v))
            else array(struct(path, v)) end)"""))
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("v").isNull() | F.is_variant_null("v"), "None").otherwise(F.try_variant_get("v", "$", "string"))
    text = F.when(F.col("kind") == "BOOLEAN", F.initcap(text)).otherwise(text)
    inner = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    if depth is None:
        return rows.where(~inner).select(key, "path", text.alias("value"))
    return rows.select(key, "path", F.when(inner, F.to_json("v")).otherwise(text).alias("value"))


def unflatten(pairs: list[tuple[str, object]], sep: str = ".") -> object:
    """A nested value out of (path, leaf) pairs; null and NaN leaves are left out; a level whose names are 0, 1, 2 ... is a list."""
    root: dict = {}
    for path, leaf in pairs:
        if leaf is None or leaf != leaf:
            continue
        at = root
        *outer, last = path.split(sep)
        for name in outer:
            at = at.setdefault(name, {})
        at[last] = leaf

    def settle(x: object) -> object:
        if not isinstance(x, dict):
            return x
        if x and sorted(x) == sorted(map(str, range(len(x)))):
            return [settle(x[str(i)]) for i in range(len(x))]
        return {k: settle(v) for k, v in x.items()}

    return settle(root)


def unflatten_rows(leaves: DataFrame, key: str, path: str, value: str, sep: str = ".") -> DataFrame:
    """(key, json): the leaves of each key, of which there are few, as one JSON text."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(zip(pdf["p"], pdf["v"], strict=True), key=lambda x: x[0])
        return pd.DataFrame({key: [pdf["k"].iloc[0]], "json": [_json.dumps(unflatten(own, sep), sort_keys=True)]})

    rows = leaves.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(value).alias("v"))
    return rows.groupBy("k").applyInPandas(build, f"`{key}` {leaves.schema[key].dataType.simpleString()}, json string")


def value_paths(value: object, leaves_only: bool = False) -> list[tuple[str, str]]:
    """(path, text) of a value and of all that it holds, each container before its contents; without containers if
    ``leaves_only``. Texts are as Python prints them."""
    out: list[tuple[str, str]] = []
    todo = [("", value)]
    while todo:
        path, x = todo.pop()
        inside = list(x.items()) if isinstance(x, dict) else list(enumerate(x)) if isinstance(x, list) else None
        if inside is None or not leaves_only:
            out.append((path, str(x)))
        todo += [(f"{path}/{name}" if path else str(name), v) for name, v in reversed(inside or [])]
    return out


def json_paths(df: DataFrame, key: str, json: str, leaves_only: bool = False) -> DataFrame:
    """(key, ord, path, value) of JSON texts in the order of their own keys, which the built-in variant type does not keep.
    Texts that cannot be parsed and nulls have no rows."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[json], strict=True):
                try:
                    rows += [(k, i, p, v) for i, (p, v) in enumerate(value_paths(_json.loads(text), leaves_only))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "ord", "path", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, json).mapInPandas(run, f"`{key}` {kind}, ord int, path string, value string")


def plain_config(config: dict | None) -> dict | str | None:
    """A run's configuration with everything that JSON can't hold as text, to any depth: objects and the parts of lists as text, dicts in them by the same rule."""
    if not isinstance(config, dict):
        return None if config is None else str(config)
    out: dict = {}
    for k, v in config.items():
        if isinstance(v, dict):
            out[k] = plain_config(v)
        elif isinstance(v, list | tuple):
            out[k] = [plain_config(x) if isinstance(x, dict) else str(x) for x in v]
        else:
            out[k] = v if v is None or isinstance(v, str | int | float | bool) else str(v)
    return out


SLICES: dict = {}


def slice_of(name: str):  # noqa: ANN201
    """Registers a slice of a run's results (DataFrame -> DataFrame) under a name, for dashboards to pick."""
    def add(f):  # noqa: ANN001, ANN202
        SLICES[name] = f
        return f

    return add


def slices(df: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """The registered slices of those names; an unknown name is an error."""
    if unknown := [n for n in names if n not in SLICES]:
        raise KeyError(f"no slice {unknown}; there are {sorted(SLICES)}")
    return {n: SLICES[n](df) for n in names}


def cached(spark, folder: str, key: str, make) -> DataFrame:  # noqa: ANN001
    """A result kept as a table in a shared folder under the hash of its key; made and written where it is missing or was left half written."""
    import hashlib

    path = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}.parquet"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
