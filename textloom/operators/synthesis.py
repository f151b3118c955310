"""Synthesis of training conversations with a pluggable batch model, and of long-context benchmarks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from textloom.functions.hashing import draw
from textloom.functions.text import assignment
from textloom.functions.tokens import count_tokens

#: A model takes the system prompts and the last messages of a batch and gives their answers; an exception fails the batch's rows only.
Model = Callable[[list[str], list[str]], list[str]]

#: Seed prompts by type. Types without a generator are refused.
SEEDS = {
    "structuring": "Arrange the material above as an outline.",
    "summarization": "Summarise the passage above in a few sentences.",
    "question": "Ask a question that the passage above answers.",
    "use_case": "Name a use to which the passage above could be put.",
    "creative": "Write something new that draws on the passage above.",
    "generic": "Comment on the passage above.",
}


def mock_model(systems: list[str], prompts: list[str]) -> list[str]:
    """A deterministic stand-in: the first words of its context, then the prompt's length."""
    return [f"{' '.join((s or '').split()[:5])} [{len(p or '')}]" for s, p in zip(systems, prompts, strict=True)]


def batch_plan(spark: SparkSession, samples: int, batch: int) -> DataFrame:
    """(batch_id, size): batches of ``batch`` samples, the last one short."""
    n = -(-samples // batch)
    return spark.range(n).select(F.col("id").alias("batch_id"), F.least(F.lit(batch), F.lit(samples) - F.col("id") * batch).cast("int").alias("size"))


def ask(df: DataFrame, system: str, prompt: str, out: str, model: Model, tries: int = 1, wait: float = 1.0) -> DataFrame:
    """Adds the model's answers, an error and the usage (prompt_tokens, completion_tokens, tries). A batch that fails is asked again up to ``tries`` times, after ``wait``
    seconds and twice as long each time; then its rows stay with the error and no answer."""
    usage = StructType([StructField(n, IntegerType()) for n in ("prompt_tokens", "completion_tokens", "tries")])
    schema = StructType([*df.schema.fields, StructField(out, StringType()), StructField(f"{out}_error", StringType()), StructField(f"{out}_usage", usage)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = lambda t: len((t or "").split())
        for pdf in batches:
            answers, error, n = [None] * len(pdf), None, 0
            for n in range(1, tries + 1):
                try:
                    answers, error = model(pdf[system].tolist(), pdf[prompt].tolist()), None
                    break
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"
                    if n < tries:
                        time.sleep(wait * 2 ** (n - 1))
            used = [{"prompt_tokens": size(s) + size(p), "completion_tokens": size(a), "tries": n} for s, p, a in zip(pdf[system], pdf[prompt], answers, strict=True)]
            yield pdf.assign(**{out: answers, f"{out}_error": [error] * len(pdf), f"{out}_usage": used})

    return df.mapInPandas(run, schema)


def self_study(contexts: DataFrame, key: str, text: str, *, per_context: int, rounds: int, seed: str, model: Model = mock_model, seed_types: tuple[str, ...] = tuple(SEEDS)) -> DataFrame:
    """(key, sample, seed_type, messages, errors): conversations in which one side asks with the context in view, by a drawn
    seed prompt, and the other answers; each round appends a question and an answer."""
    unknown = set(seed_types) - set(SEEDS)
    if unknown:
        raise ValueError(f"no generator for seed types {sorted(unknown)}")
    rows = contexts.select(key, text, F.explode(F.sequence(F.lit(0), F.lit(per_context - 1))).alias("sample"))
    kinds = F.array(*map(F.lit, seed_types))
    rows = rows.withColumn("seed_type", F.element_at(kinds, (draw(seed, key, "sample") % len(seed_types) + 1).cast("int")))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in SEEDS.items() for x in kv]), F.col("seed_type"))
    rows = rows.withColumn("messages", F.array().cast("array<struct<role:string,content:string>>")).withColumn("errors", F.array().cast("array<string>")).withColumn("__say", first)
    for _ in range(rounds):
        for role, column in (("user", "__q"), ("assistant", "__a")):
            rows = ask(rows, text, "__say", column, model)
            rows = rows.withColumn("messages", F.concat("messages", F.array(F.struct(F.lit(role).alias("role"), F.col(column).alias("content")))))
            rows = rows.withColumn("errors", F.concat("errors", F.array_compact(F.array(f"{column}_error")))).withColumn("__say", F.col(column)).drop(column, f"{column}_error", f"{column}_usage")
    return rows.drop("__say", text)


def note_prompts(patients: DataFrame, key: str, notes: str, draws: DataFrame, draw_key: str, seed: str, least: int, most: int, size: int) -> DataFrame:
    """(draw, key, n_notes, context): for each draw a patient, each as likely, and of ``least`` to ``most`` notes drawn without repetition (all if there are fewer), each cut to a window of
    ``size`` letters. notes: map<string,string> of the patient's notes by id."""
    from textloom.functions.text import ellipsis_chunk

    numbered_, n = numbered(patients.select(F.pmod(F.xxhash64(key), F.lit(1 << 40)).alias("__h"), key, notes), ["__h", key], "__i")
    if not n:
        return draws.select(draw_key).limit(0).select(draw_key, F.lit(None).alias(key), F.lit(0).alias("n_notes"), F.lit("").alias("context"))
    rows = draws.select(draw_key).withColumn("__i", draw(seed, F.lit("patient"), draw_key) % n).join(numbered_, "__i")
    count = (F.lit(least) + draw(seed, F.lit("count"), draw_key) % (most - least + 1)).cast("int")
    ranked = F.array_sort(F.transform(F.map_entries(notes), lambda e: F.struct(draw(seed, F.lit("note"), F.col(draw_key), e["key"]).alias("u"), e["key"].alias("id"), e["value"].alias("text"))))
    start = lambda e: draw(seed, F.lit("start"), F.col(draw_key), e["id"]) % F.greatest(F.length(e["text"]) - size + 1, F.lit(1))
    one = lambda e: F.concat(F.lit("<"), e["id"], F.lit(">\n"), ellipsis_chunk(e["text"], start(e), size), F.lit("\n</"), e["id"], F.lit(">"))
    chosen = rows.withColumn("__n", F.slice(ranked, F.lit(1), F.least(count, F.size(notes))))
    return chosen.select(draw_key, key, F.size("__n").alias("n_notes"), F.array_join(F.transform("__n", one), "\n").alias("context"))


def excerpt(text: Column, seed: str, key: Column | str, least: int, most: int, description: str) -> Column:
    """A drawn window of ``least`` to ``most`` tokens of a book under a line that says what it is; a shorter book as a whole."""
    from textloom.functions.tokens import split_tokens

    words = split_tokens(text)
    size = F.least(F.lit(least) + draw(seed, F.lit("size"), key) % (most - least + 1), F.size(words)).cast("int")
    start = (draw(seed, F.lit("start"), key) % (F.size(words) - size + 1)).cast("int")
    return F.concat(F.lit(f"{description}\n\n"), F.array_join(F.slice(words, start + 1, size), " "))


def word_lines(words: Column | str) -> Column:
    """Lines ``source: target,target`` of a word list (map<string,array<string>>)."""
    return F.transform(F.map_entries(words), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ",")))


#: The frames of a translation benchmark's context.
BOOK_FRAME = ('"%s":\nSTART OF GRAMMAR BOOK\n', "\nEND OF GRAMMAR BOOK\n\nThe grammar book is now over.")
WORD_FRAME = ("Now here is the bilingual word list:\n\nSTART OF WORD LIST\n", "\nEND OF WORD LIST\n\nThe bilingual word list is now over.")
SENTENCE_FRAME = ("Here is the collection of parallel sentences:\n\nSTART OF PARALLEL SENTENCES\n", "\nEND OF PARALLEL SENTENCES\n\nThe collection of parallel sentences is now over.")


def translation_context(book: Column, title: str, whole: bool, words: Column | None = None, pairs: Column | None = None) -> Column:
    """A book, and after it a word list's lines and parallel sentences (array<struct<original,translation>>) where they are given, each in its frame."""
    lead = "Here is the book, " if whole else "Here is a subset of the book, "
    parts = [F.concat(F.lit(lead + BOOK_FRAME[0] % title), book, F.lit(BOOK_FRAME[1]))]
    if words is not None:
        parts.append(F.concat(F.lit(WORD_FRAME[0]), F.array_join(words, "\n"), F.lit(WORD_FRAME[1])))
    if pairs is not None:
        lines = F.transform(pairs, lambda p: F.concat(p["original"], F.lit(":"), p["translation"]))
        parts.append(F.concat(F.lit(SENTENCE_FRAME[0]), F.array_join(lines, "\n"), F.lit(SENTENCE_FRAME[1])))
    return F.concat_ws("\n\n", *parts)


# ---------------------------------------------------------------- benchmarks


def depth_points(n: int, points: int = 512) -> list[int]:
    """Places int(n * depth / 100) for evenly spread, rounded depths from 0 to 100."""
    return [int(n * round(i * 100 / (points - 1)) / 100) for i in range(points)]


def haystack_fit(sentences: DataFrame, doc: str, pos: str, text: str, budget: int, reserve: int) -> DataFrame:
    """(doc, sentences, tokens): how many first sentences of each document fit in ``budget`` tokens with ``reserve`` kept free, by
    running sums in place of a search."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = sentences.select(doc, pos, F.sum(count_tokens(text)).over(w).alias("cum"))
    return rows.where(F.col("cum") + reserve <= budget).groupBy(doc).agg(F.count("*").alias("sentences"), F.max("cum").alias("tokens"))


def haystack_size(units: DataFrame, doc: str, pos: str, text: str, budget: int, reserve: int) -> DataFrame:
    """(doc, units, cycles, tokens): how many units of each document, which is said again from its beginning as often as needed, fit in
    ``budget`` tokens with ``reserve`` kept free. Running sums take the place of a search: whole cycles first, then the last one's beginning.
    Documents without tokens have no row."""
    room = budget - reserve
    w = Window.partitionBy(doc).orderBy(pos)
    rows = units.select(doc, pos, count_tokens(text).alias("t")).withColumn("cum", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(w))
    whole = Window.partitionBy(doc)
    rows = rows.withColumn("all", F.sum("t").over(whole)).withColumn("n", F.count("*").over(whole)).where((F.col("all") > 0) & (F.lit(room) > 0))
    cycles = F.floor(F.lit(room) / F.col("all"))
    fits = F.col("cum") <= F.lit(room) - cycles * F.col("all")
    return rows.groupBy(doc).agg(
        (F.first(cycles * F.col("n")) + F.count(F.when(fits, 1))).alias("units"), F.first(cycles).cast("long").alias("cycles"),
        (F.first(cycles * F.col("all")) + F.coalesce(F.max(F.when(fits, F.col("cum"))), F.lit(0))).cast("long").alias("tokens"),
    )


def shrink_to_fit(samples: DataFrame, units: Column | str, tokens: Column | str, budget: int, tokens_per_unit: Column | str, step: int) -> DataFrame:
    """Adds ``used``: the units of each sample, taken back by ``step`` as often as its ``tokens`` are above the budget, in one
    expression; at least ``step`` are left, or all where there are fewer. A sample that still does not fit has null."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    n, size, each = c(units), c(tokens), c(tokens_per_unit)
    over = F.greatest(size - budget, F.lit(0))
    used = n - F.ceil(over / (each * step)) * step
    return samples.withColumn("used", F.when(over == 0, n).when((n > step) & (used >= F.least(n, F.lit(step))), used).cast("long"))


def needles(spark: SparkSession, keys: int, values: int, seed: str) -> DataFrame:
    """(needle, key, value): ``keys`` distinct keys with ``values`` numbers of seven digits each."""
    n = spark.range(keys * values)
    k = F.floor(F.col("id") / values)
    return n.select(F.col("id").alias("needle"), F.format_string("key-%05d-%04d", draw(seed, F.lit("key"), k) % 100000, k).alias("key"), (F.lit(1_000_000) + draw(seed, F.lit("value"), "id") % 9_000_000).cast("string").alias("value"))


def numbered(rows: DataFrame, order: list[str], out: str) -> tuple[DataFrame, int]:
    """The rows with their number from 0 in the order of the columns, and how many there are. Blocks are ranges of the first
    column, counted first (one row a block reaches the driver, at most 1,000), so no task sees more than one block."""
    first = order[0]
    ends = rows.agg(F.min(first).alias("lo"), F.max(first).alias("hi")).first()
    if ends["lo"] is None:
        return rows.withColumn(out, F.lit(0).cast("long")), 0
    width = (ends["hi"] - ends["lo"]) // 1000 + 1
    rows = rows.withColumn("__block", F.expr(f"cast(({first} - {ends['lo']}L) div {width}L as int)"))
    counts = {r["__block"]: r["count"] for r in rows.groupBy("__block").count().collect()}
    starts, n = [], 0
    for b in range(max(counts) + 1):
        starts.append(n)
        n += counts.get(b, 0)
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(*order)) - 1
    start = F.element_at(F.lit(starts), F.col("__block") + 1)
    return rows.withColumn(out, (start + rank).cast("long")).drop("__block"), n


def hide_needles(sentences: DataFrame, pos: str, text: str, hidden: DataFrame, n: int, seed: str) -> DataFrame:
    """(ord, text) of one haystack of ``n`` sentences with each needle's sentence before a drawn depth place; several
    needles at one place stand in the order of their numbers."""
    places = depth_points(n)
    at = F.element_at(F.array(*map(F.lit, places)), (draw(seed, F.lit("depth"), "needle") % len(places) + 1).cast("int"))
    line = F.format_string("One of the special magic numbers for %s is: %s.", F.col("key"), F.col("value"))
    a = sentences.select((F.col(pos) * 2 + 1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col(text).alias("text"))
    b = hidden.select((at * 2).cast("long").alias("a"), F.col("needle").alias("b"), line.alias("text"))
    return a.unionAll(b).orderBy("a", "b").select(F.concat_ws(".", F.format_string("%012d", "a"), F.format_string("%06d", "b")).alias("ord"), "text")


def needle_queries(hidden: DataFrame) -> DataFrame:
    """(key, question, answers): one query a key, its answers in the order hidden, worded by how many there are."""
    answers = F.transform(F.array_sort(F.collect_list(F.struct("needle", "value"))), lambda x: x["value"])
    rows = hidden.groupBy("key").agg(answers.alias("answers"))
    one, many = "What is the special magic number for %s?", "What are all the special magic numbers for %s?"
    return rows.select("key", F.when(F.size("answers") == 1, F.format_string(one, "key")).otherwise(F.format_string(many, "key")).alias("question"), "answers")


def variable_chains(spark: SparkSession, chains: int, hops: int, seed: str, style: str = "ruler") -> DataFrame:
    """(chain, hop, var, source, literal, line): a literal head, then aliases of the variable before; names are distinct by their
    number. The lines of all chains, ordered by ``priority``, keep each chain's order."""
    rows = spark.range(chains * (hops + 1)).select((F.col("id") / (hops + 1)).cast("long").alias("chain"), (F.col("id") % (hops + 1)).alias("hop"), "id")
    name = lambda i: F.concat(F.translate(F.substring(F.md5(F.concat(F.lit(seed), i.cast("string"))), 1, 5), "0123456789", "GHIJKLMNOP"), i.cast("string"))
    literal = (F.lit(10_000) + draw(seed, F.lit("literal"), "chain") % 90_000).cast("string")
    rows = rows.select("chain", "hop", F.upper(name(F.col("id"))).alias("var"), F.when(F.col("hop") > 0, F.upper(name(F.col("id") - 1))).alias("source"), literal.alias("literal"))
    value = F.coalesce("source", "literal")
    u = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(hops)), lambda h: draw(seed, F.lit("mix"), F.col("chain"), h)))
    return rows.withColumn("line", assignment(F.col("var"), value, style, F.col("source").isNull())).withColumn("priority", F.element_at(u, F.col("hop").cast("int") + 1))


def resolve_chains(edges: DataFrame, hops: int) -> DataFrame:
    """(var, value): the literal that each variable comes to, by following aliases. Path doubling: each pass joins every
    open alias with what its source points to, so log2(hops) passes do."""
    state = edges.select("var", "source", F.when(F.col("source").isNull(), F.col("literal")).alias("value"))
    for _ in range(max(1, hops).bit_length() + 1):
        up = state.select(F.col("var").alias("source"), F.col("source").alias("__next"), F.col("value").alias("__value"))
        state = state.join(up, "source", "left").select("var", F.when(F.col("value").isNull(), F.col("__next")).alias("source"), F.coalesce("value", "__value").alias("value"))
    return state.select("var", "value")
