"""Problem 6: find evaluation texts inside training text, and remove them.

The held-out texts give a set of n-grams of normalised words. Every training text is read in full, word
by word; whole Arrow batches are turned into one array of word numbers, windows of n known words are
hashed together, looked up in the sorted hashes, and each hit is verified word for word.

The set is sent to the workers only if its size, counted first, is within ``max_ngrams``; beyond it the
windows of both sides are joined by 128 bits of hash instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import spread

N = 8
MAX_NGRAMS = 2_000_000
WORD = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"[^\W_]+|\x00")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


class NgramSet:
    """The n-grams of the held-out texts, as numbers of words and sorted hashes."""

    def __init__(self, texts: list[tuple[int, str | None]], n: int = N) -> None:
        self.n = n
        self.number: dict[str, int] = {}
        grams: dict[tuple[int, ...], set[int]] = {}
        for item, text in texts:
            ids = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            for i in range(len(ids) - n + 1):
                grams.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.grams = {g: tuple(sorted(items)) for g, items in grams.items()}
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
        self.values = rng.integers(1, 2**63, max(1, len(self.number)), dtype=np.uint64)
        keys = np.array(list(self.grams), dtype=np.int64).reshape(-1, n)
        self.hashes = np.unique((self.values[keys] * self.factors).sum(axis=1, dtype=np.uint64)) if len(keys) else np.zeros(0, np.uint64)

    def hits(self, texts: list[str | None]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(index of the text, number of the window's first word, items) of every window found."""
        get = self.number.get
        joined = "\x00".join(t.replace("\x00", " ") if t else "" for t in texts).lower()
        found = _SPLIT.findall(joined)
        ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        if len(ids) < self.n or not len(self.hashes):
            return
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        at = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        if not len(at):
            return
        value = self.values[np.maximum(ids, 0)]
        h = np.zeros(len(at), np.uint64)
        for k in range(self.n):
            h += value[at + k] * self.factors[k]
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = at[self.hashes[place] == h]
        if not len(at):
            return
        breaks = np.flatnonzero(np.fromiter((w == "\x00" for w in found), bool, len(found)))
        text_of = np.searchsorted(breaks, at)
        for i, k in zip(at.tolist(), text_of.tolist(), strict=True):
            items = self.grams.get(tuple(ids[i : i + self.n].tolist()))  # word for word
            if items:
                yield k, i - (int(breaks[k - 1]) + 1 if k else 0), items


def _windows(texts: DataFrame, text_cols: list[str], n: int) -> int:
    """Number of n-grams of the texts, counted before they are sent anywhere."""
    size = sum((F.greatest(F.regexp_count(F.col(c), F.lit(r"[\p{L}\p{N}]+")) - (n - 1), F.lit(0)) for c in text_cols), F.lit(0))
    return texts.select(F.coalesce(size, F.lit(0)).alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first()["s"]


def leaks(corpus: DataFrame, key_cols: list[str], text_cols: list[str], held_out: DataFrame, item_col: str, held_cols: list[str], *, n: int = N, max_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """(keys, item, windows, first_word): each record and held-out item that share ``n`` consecutive words.

    A record's columns are read each for itself, so no window runs across two of them, and the same
    holds for an item's. Null, blank and shorter texts share nothing. ``windows`` counts the shared windows.
    """
    keys = corpus.select(*key_cols).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + f", `{item_col}` long, windows long, first_word long"
    if _windows(held_out, held_cols, n) > max_ngrams:
        return _joined(corpus, key_cols, text_cols, held_out, item_col, held_cols, n)
    rows = held_out.select(item_col, *held_cols).collect()  # its n-grams were counted above
    grams = NgramSet([(r[item_col], r[c]) for r in rows for c in held_cols], n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, int], list[int]] = {}
            for c in text_cols:
                texts = batch.column(batch.schema.get_field_index(c)).to_pylist()
                for row, first, items in grams.hits(texts):
                    for item in items:
                        seen = best.setdefault((row, item), [0, first])
                        seen[0] += 1
            if best:
                take = pa.array([r for r, _ in best], pa.int64())
                cols = [batch.column(batch.schema.get_field_index(k)).take(take) for k in key_cols]
                rest = [[i for _, i in best], [v[0] for v in best.values()], [v[1] for v in best.values()]]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in rest)], names=[*key_cols, item_col, "windows", "first_word"])

    return spread(corpus.select(*key_cols, *text_cols)).mapInArrow(scan, out)


SALTS = 16  # parts that the windows of one n-gram are spread over where both sides meet


def _hashed(df: DataFrame, keep: list[str], text_cols: list[str], n: int) -> DataFrame:
    """(keep, __at, __h, __g): the windows of each text by two hashes of 64 bits, so that no window is moved as text."""
    each = F.explode(F.array(*text_cols)).alias("__t")
    w = F.regexp_extract_all(F.lower("__t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("__w")
    listed = df.select(*keep, each).select(*keep, w).where(F.size("__w") >= n)
    at = listed.select(*keep, "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - n)).alias("__at"))
    gram = F.concat_ws(" ", F.slice("__w", F.col("__at") + 1, n))
    return at.select(*keep, "__at", F.xxhash64(gram).alias("__h"), F.xxhash64(F.lit(n), F.reverse(gram)).alias("__g"))


def _meet(own: DataFrame, held: DataFrame) -> DataFrame:
    """Windows of both sides with the same hashes; those of an n-gram that a large part of the corpus holds are spread over SALTS tasks."""
    own = own.withColumn("__salt", F.pmod(F.xxhash64("__at", *[c for c in own.columns if c[:2] != "__"]), F.lit(SALTS)))
    held = held.distinct().withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return own.join(held, ["__h", "__g", "__salt"])


def _joined(corpus: DataFrame, key_cols: list[str], text_cols: list[str], held_out: DataFrame, item_col: str, held_cols: list[str], n: int) -> DataFrame:
    """The same result for held-out sets of any size: windows of both sides meet in a shuffle by 128 bits of hash."""
    held = _hashed(held_out.select(F.col(item_col).alias("item__"), *held_cols), ["item__"], held_cols, n).select("item__", "__h", "__g")
    own = _hashed(corpus.select(*key_cols, *text_cols), key_cols, text_cols, n)
    return _meet(own, held).groupBy(*key_cols, F.col("item__").alias(item_col)).agg(F.count("*").alias("windows"), F.min("__at").cast("long").alias("first_word"))


def remove_leaks(corpus: DataFrame, text_col: str, held_out: DataFrame, held_cols: list[str], *, n: int = N, mask: str = " ", max_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """``corpus`` with ``text_col`` freed of every span of ``n`` or more words that is in a held-out text; a
    span goes from its first word's start to its last word's end and leaves ``mask``. Other columns
    and texts without a leak stay as they are. A held-out set beyond ``max_ngrams`` is joined by hash instead of sent to the workers."""
    if _windows(held_out, held_cols, n) > max_ngrams:
        return _removed_by_join(corpus, text_col, held_out, held_cols, n, mask)
    rows = held_out.select(*held_cols).collect()  # its n-grams were counted above
    grams = NgramSet([(0, r[c]) for r in rows for c in held_cols], n)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            spans: dict[int, list[int]] = {}
            for row, first, _ in grams.hits(texts):
                spans.setdefault(row, []).append(first)
            for row, firsts in spans.items():
                texts[row] = cut_spans(texts[row], firsts, n, mask)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return spread(corpus).mapInArrow(clean, corpus.schema)


def _removed_by_join(corpus: DataFrame, text_col: str, held_out: DataFrame, held_cols: list[str], n: int, mask: str) -> DataFrame:
    """The places of the leaked windows are found once for each distinct text, by its hash, and joined to the rows that have
    it, spread over SALTS tasks a text."""
    name = F.sha2(F.col(text_col), 256)
    texts = corpus.select(F.col(text_col).alias("text__")).where("text__ is not null").distinct().select(F.sha2("text__", 256).alias("sha__"), "text__")
    held = _hashed(held_out.select(*held_cols), [], held_cols, n).select("__h", "__g")
    places = _meet(_hashed(texts, ["sha__"], ["text__"], n), held).groupBy("sha__").agg(F.collect_set("__at").alias("__places"))  # at most one a word of the text
    spread_over = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    places = places.withColumn("__part", spread_over).withColumnRenamed("sha__", "__sha")
    rows = corpus.withColumn("__sha", name).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    joined = rows.join(places, ["__sha", "__part"], "left").select(*[F.col(f"`{c}`") for c in corpus.columns], "__places")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, places_ = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            cols = list(batch.columns[:-1])
            cols[at] = pa.array([cut_spans(t, p, n, mask) if p else t for t, p in zip(texts, places_, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return joined.mapInArrow(clean, corpus.schema)


def cut_spans(text: str, firsts: list[int], n: int, mask: str) -> str:
    """The text without the words first..first+n-1 of each window; words are counted in lower case, where
    a few letters become two, so their places are looked up letter by letter."""
    low, origin = [], []
    for i, ch in enumerate(text):
        for c in ch.lower():
            low.append(c)
            origin.append(i)
    places = [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(low))]
    out, end = [], 0
    for first in sorted(firsts):
        a, b = places[first][0], places[first + n - 1][1]
        if a > end or not out:
            out.append(text[end:a])
        end = max(end, b)
    return mask.join([*out, text[end:]])
