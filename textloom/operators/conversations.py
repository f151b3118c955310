"""Conversations as nested rows: conv_id, messages ARRAY<STRUCT<role, content>>, and their long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.tokens import control, count_tokens, token_ids
from textloom.operators.logprobs import leading_mass


def message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.col(content) if isinstance(content, str) else content).alias("content"))


def from_responses(responses: DataFrame) -> DataFrame:
    """One conversation a model response: its prompt's messages, then the answer. A null prompt counts as no message."""
    prompt = F.coalesce("prompt_messages", F.array().cast("array<struct<role:string,content:string>>"))
    return responses.select(F.col("response_id").alias("conv_id"), F.concat(prompt, F.array(message("assistant", "text"))).alias("messages"))


def to_long(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content); null messages have no row but keep their turn."""
    return conversations.select("conv_id", F.posexplode("messages").alias("turn", "m")).where("m is not null").select("conv_id", "turn", "m.role", "m.content")


def to_nested(long: DataFrame) -> DataFrame:
    """The inverse of :func:`to_long`."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return long.groupBy("conv_id").agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def flip_roles(messages: Column | str) -> Column:
    """user and assistant change places; other roles stay."""
    return F.transform(
        messages,
        lambda m: F.struct(F.when(m["role"] == "user", "assistant").when(m["role"] == "assistant", "user").otherwise(m["role"]).alias("role"), m["content"].alias("content")),
    )


def with_system(messages: Column | str, prompt: Column) -> Column:
    """The messages after a system message, where there is one to add."""
    col = F.col(messages) if isinstance(messages, str) else messages
    return F.when(prompt.isNotNull(), F.concat(F.array(F.struct(F.lit("system").alias("role"), prompt.alias("content"))), col)).otherwise(col)


def prompt_and_answer(conversations: DataFrame) -> DataFrame:
    """(conv_id, prompt, answer) of conversations of two or more messages that end with the assistant; others are left out."""
    last = F.element_at("messages", -1)
    return conversations.where((F.size("messages") >= 2) & (last["role"] == "assistant")).select(
        "conv_id", F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"), last["content"].alias("answer")
    )


def message_offsets(long: DataFrame, family: str) -> DataFrame:
    """Adds start_tokens, own_tokens, end_tokens and the running offset of each message within its conversation."""
    size = lambda part: F.size(control(family, F.col("role"), part)).cast("long")
    rows = long.withColumn("start_tokens", size(0)).withColumn("own_tokens", count_tokens("content")).withColumn("end_tokens", size(1) + size(2))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.col("start_tokens") + F.col("own_tokens") + F.col("end_tokens")).over(before), F.lit(0)).cast("long"))


def to_element(conversations: DataFrame, family: str) -> DataFrame:
    """(conv_id, input_ids, target_idx): all messages retokenised with their control tokens; targets are the places
    of every assistant token after its start tokens, the closing ones included. No assistant gives no targets."""
    def ids(m: Column) -> Column:
        return F.concat(*[x.cast("array<int>") for x in (control(family, m["role"], 0), F.coalesce(token_ids(m["content"]), F.array().cast("array<int>")), control(family, m["role"], 1), control(family, m["role"], 2))])

    def flags(m: Column) -> Column:
        start = F.size(control(family, m["role"], 0))
        extra = F.size(control(family, m["role"], 2))
        rest = F.size(ids(m)) - start - extra
        return F.concat(F.array_repeat(F.lit(0), start), F.array_repeat((m["role"] == "assistant").cast("int"), rest), F.array_repeat(F.lit(0), extra))

    rows = conversations.select("conv_id", F.flatten(F.transform("messages", ids)).alias("input_ids"), F.flatten(F.transform("messages", flags)).alias("flags"))
    marked = F.filter(F.transform("flags", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return rows.select("conv_id", "input_ids", marked.alias("target_idx"))


STORED = "array<struct<role:string,content:string,token_ids:array<int>,logprobs:array<struct<token_idx:int,token_id:int,logprob:double>>>>"


def training_rows(chats: DataFrame, key: str, system: str, threshold: float = 0.99) -> DataFrame:
    """(key, system_prompt, messages): chats whose messages carry a model's dense answer (role, content, token_ids, top_logprobs
    array<array<double>>, top_ids array<array<int>>) as training rows, their log probabilities cut to the leading alternatives
    that hold ``threshold`` of the mass. Messages without them keep null."""
    def one(m: Column) -> Column:
        flat = F.when(m["top_logprobs"].isNotNull(), leading_mass(m["top_logprobs"], m["top_ids"], threshold))
        return F.struct(m["role"].alias("role"), m["content"].alias("content"), m["token_ids"].alias("token_ids"), flat.alias("logprobs"))

    return chats.select(key, F.col(system).alias("system_prompt"), F.transform("messages", one).alias("messages"))


def to_stored_element(conversations: DataFrame, family: str) -> DataFrame:
    """(conv_id, input_ids, targets): messages (``STORED``) by the ids that the model gave, retokenised only where there are none.

    A message that is not the last gets its end tokens unless its ids end with them already (a cut-off answer), and then those
    that follow an end; the last one stays as it is. Targets are the stored log probabilities, moved to the place of their
    message. Null messages are left out."""
    messages = F.filter("messages", lambda m: m.isNotNull())
    none = F.array().cast("array<int>")

    def ids(m: Column, i: Column) -> Column:
        start, end, extra = (control(family, m["role"], part) for part in (0, 1, 2))
        own = F.concat(start, F.coalesce(m["token_ids"], token_ids(m["content"]).cast("array<int>"), none))
        n = F.size(end)
        ended = F.when(F.size(own) >= n, F.slice(own, F.greatest(F.size(own) - n + 1, F.lit(1)), n) == end).otherwise(False)
        return F.when(i == F.size(messages) - 1, own).when(ended, F.concat(own, extra)).otherwise(F.concat(own, end, extra))

    rows = conversations.select("conv_id", messages.alias("messages"), F.transform(messages, ids).alias("ids"))
    sizes = F.transform("ids", lambda x: F.size(x))
    before = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda s, x: s + x)

    def moved(m: Column, i: Column) -> Column:
        at = before(i) + F.size(control(family, m["role"], 0))
        empty = F.array().cast("array<struct<token_idx:int,token_id:int,logprob:double>>")
        return F.transform(F.coalesce(m["logprobs"], empty), lambda t: F.struct((t["token_idx"] + at).alias("token_idx"), t["token_id"].alias("token_id"), t["logprob"].alias("logprob")))

    return rows.select("conv_id", F.flatten("ids").alias("input_ids"), F.flatten(F.transform("messages", moved)).alias("targets"))


def fit_suffix(long: DataFrame, limit: int, size: Column) -> DataFrame:
    """The longest run of last messages of each conversation whose sizes sum to at most ``limit``."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("size", size).withColumn("size_to_end", F.sum("size").over(after)).where(F.col("size_to_end") <= limit)


def common_prefix(histories: DataFrame) -> DataFrame:
    """(conv_id, ord, prefix): length of the longest run of first messages that an earlier history of the same
    conversation also starts with; 0 if there is none. histories: conv_id, ord, messages (array of strings).

    Every history offers the hash of each of its prefixes, and the first history to offer one is its owner,
    so histories are never paired with each other.
    """
    keys = F.transform(F.sequence(F.lit(1), F.size("messages")), lambda n: F.struct(n.alias("n"), F.sha2(F.to_json(F.slice("messages", F.lit(1), n)), 256).alias("h")))
    prefixes = histories.where(F.size("messages") > 0).select("conv_id", "ord", F.explode(keys).alias("k")).select("conv_id", "ord", "k.n", "k.h")
    first = Window.partitionBy("conv_id", "n", "h")
    seen = prefixes.withColumn("first", F.min("ord").over(first)).where(F.col("first") < F.col("ord")).groupBy("conv_id", "ord").agg(F.max("n").alias("prefix"))
    return histories.select("conv_id", "ord").join(seen, ["conv_id", "ord"], "left").select("conv_id", "ord", F.coalesce("prefix", F.lit(0)).alias("prefix"))
