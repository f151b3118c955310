"""Problem 1: cut oversized texts at natural boundaries, with overlap.

A regular expression of bounded quantifiers eats the text piece by piece. Its alternatives stand in
the order of the boundaries' strength; each takes as much as the limit allows (greedy), and the last
one, plain characters, always matches, so that the matches cover the text without a gap. The overlap
is looked back at with array functions: piece n starts with the last ``overlap`` characters of what
came before it. All of it runs in the JVM, row by row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries, strongest first, with the most characters that each takes.
#: Blank line; end of line; end of sentence with closing quotes or brackets; clause; white space.
BOUNDARIES = (
    (r"\n[^\S\n]{0,4}+\n\s{0,4}+", 10),
    (r"\n\s{0,4}+", 5),
    (r"[.!?…。！？][\"'”’»)\]]{0,3}+\s{1,4}+", 8),
    (r"[,;:–—]\s{1,4}+", 5),
    (r"\s{1,4}+", 4),
)
#: A boundary counts only in the last part of the room, else pieces would become needlessly short.
LEAST_FILL = 0.5


def pattern(max_size: int, overlap: int) -> str:
    """The expression for pieces that leave room for the overlap; ``{m,n}`` counts Unicode characters."""
    if not 0 <= overlap < max_size:
        raise ValueError(f"overlap must be at least 0 and below max_size, not {overlap} of {max_size}")
    room = max_size - overlap
    least = _least(room)
    # Greedy from the far end of the room, leaving space for the boundary; the rest of a text needs no cut.
    cuts = [f".{{{max(1, min(least, room - most))},{room - most}}}{b}" for b, most in BOUNDARIES if room > most]
    return "(?s)" + "|".join([f".{{1,{room}}}+\\z", *cuts, f".{{1,{room}}}"])


def _least(room: int) -> int:
    return max(1, int(room * LEAST_FILL))


def bodies(text: Column, max_size: int, overlap: int) -> Column:
    """The text cut into consecutive bodies; joined together they are the text again."""
    return F.regexp_extract_all(text, F.lit(pattern(max_size, overlap)), F.lit(0))


def split_items(df: DataFrame, text_col: str, max_size: int, overlap: int, *, only_oversized: bool = False) -> DataFrame:
    """Adds ``piece_no``, ``overlap`` (characters shared with the piece before) and ``piece``, one row a piece.

    No piece is longer than ``max_size``; from the second on each starts with the last ``overlap``
    characters before its own text. Null texts give no row. Columns of ``df`` with one of the three
    names keep their values under the name with an underscore. ``only_oversized`` leaves out items that are within the limit.
    """
    for name in ("piece_no", "overlap", "piece"):
        if name in df.columns:
            free = name + "_"
            while free in df.columns:
                free += "_"
            df = df.withColumnRenamed(name, free)
            text_col = free if text_col == name else text_col
    if only_oversized:
        df = df.where(F.length(text_col) > max_size)
    # The bodies are made in a projection of their own, so that they are cut once.
    cut = F.when(F.length(text_col) > max_size, bodies(F.col(text_col), max_size, overlap)).otherwise(F.array(F.col(text_col)))
    rows = df.where(F.col(text_col).isNotNull()).withColumn("__bodies", cut)

    back = -(-overlap // _least(max_size - overlap))  # so many bodies hold the overlap, whatever their lengths

    def piece(body: Column, i: Column) -> Column:
        head = F.lit("")
        if overlap:
            last = F.slice("__bodies", F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back)))
            head = F.when(i > 0, F.right(F.array_join(last, ""), F.lit(overlap))).otherwise(head)
        return F.struct(i.cast("int").alias("piece_no"), F.length(head).alias("overlap"), F.concat(head, body).alias("piece"))

    return rows.withColumn("__pieces", F.transform("__bodies", piece)).drop("__bodies").select(
        *[F.col(f"`{c}`") for c in df.columns], F.inline("__pieces")
    )
