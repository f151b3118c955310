"""Text functions, each from columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words left out of retrieval. Fixed values, a common list.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its "
    "just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your"
).split()


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_tag(text: Column | str, tag: str, *, ignore_case: bool = False, fallback: bool = False) -> Column:
    """What stands in the first <tag>...</tag>, trimmed and in lower case; without one null, or with ``fallback`` all of the text."""
    pattern = f"(?s{'i' if ignore_case else ''})<{tag}>(.*?)</{tag}>"
    inner = F.when(c(text).rlike(pattern), F.regexp_extract(text, pattern, 1))
    return F.lower(F.trim(F.coalesce(inner, c(text)) if fallback else inner))


def tag_lines(text: Column | str, tag: str) -> Column:
    """The distinct non-empty lines of all blocks of a tag, trimmed and in lower case."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    lines = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def answer_set(text: Column | str) -> Column:
    """The answers after the last colon: brackets, quotes and full stops trimmed, split at commas."""
    chars = "{}'\" .,\t\n"
    return F.transform(F.split(F.btrim(F.substring_index(c(text), ":", -1), F.lit(chars)), ","), lambda x: F.btrim(x, F.lit(chars)))


def after_thought(text: Column | str, close: str = "</think>", end: str = "") -> Column:
    """What follows the last closing tag of a train of thought, without an end-of-turn mark."""
    out = F.when(F.contains(c(text), F.lit(close)), F.substring_index(c(text), close, -1)).otherwise(c(text))
    return F.when(F.endswith(out, F.lit(end)), F.substr(out, F.lit(1), F.length(out) - len(end))).otherwise(out) if end else out


def retrieval_terms(text: Column | str) -> Column:
    """Lower-case words without punctuation and stop words, repeats kept."""
    bare = F.regexp_replace(F.lower(c(text)), r"[^\p{L}\p{N}_\s]", "")
    words = F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))  # a hash set, not a list to go through


def collapse(text: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c(text), r"\s+", " "))


def sentences(text: Column | str) -> Column:
    """Pieces that end with a full stop, question or exclamation mark before white space; empty ones left out."""
    marked = F.regexp_replace(c(text), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def strip_latex_comments(text: Column | str) -> Column:
    """Lines cut at the first % that no backslash escapes, trimmed at the right; empty lines dropped."""
    lines = F.split(F.regexp_replace(c(text), r"(?m)(?<!\\)%.*$", ""), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.rtrim(x)), lambda x: F.trim(x) != ""), "\n")


def between_markers(text: Column | str, start: str, end: str) -> Column:
    """From the first start marker to the first end marker after it, both included; else empty."""
    text = c(text)
    a = F.locate(start, text)
    rest = F.substr(text, F.greatest(a, F.lit(1)))
    b = F.when(F.length(rest) > len(start), F.locate(end, F.substr(rest, F.lit(len(start) + 1)))).otherwise(0)
    return F.when((a > 0) & (b > 0), F.substr(rest, F.lit(1), b + len(start) + len(end) - 1)).otherwise(F.lit(""))


def visible_html(html: Column | str) -> Column:
    """Text of a page: scripts, styles, comments and tags out, block ends as line breaks, common entities decoded."""
    out = F.regexp_replace(c(html), r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/section|/article)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def fixed_chunks(text: Column | str, size: int) -> Column:
    """array<struct<chunk_no, chunk>> of ``size`` characters each, the last with the rest; empty text has none."""
    text = c(text)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("chunk_no"), F.substr(text, i * size + 1, F.lit(size)).alias("chunk")))


def ellipsis_chunk(text: Column | str, start: Column, size: int) -> Column:
    """A window of a long note between dots; a note within the size as it is."""
    text = c(text)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.lit("... "), F.substr(text, start + 1, F.lit(size)), F.lit(" ...")))


def addresses(line: Column | str) -> Column:
    """The parts of an address line at commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c(line), ","), lambda x: F.trim(x)), lambda x: x != "")


def header(headers: Column, name: str, default: str = "") -> Column:
    """Value of the first header of a name, whatever its case."""
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.get(hit, 0)["value"], F.lit(default))


def base64url_text(data: Column | str) -> Column:
    """UTF-8 text of URL-safe base64, with or without padding; null if it isn't."""
    return F.decode(F.unbase64(F.translate(c(data), "-_", "+/")), "UTF-8")


def tool_calls(text: Column | str) -> Column:
    """JSON bodies of the tool calls in a text, an unterminated last one included; bodies that are no JSON objects with a name
    and arguments are dropped."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)(?:</tool_call>|$)"), F.lit(1)), lambda b: F.trim(b))
    return F.filter(bodies, lambda b: F.get_json_object(b, "$.name").isNotNull() & F.get_json_object(b, "$.arguments").isNotNull())


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of the same length; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(c(a), c(a)) * dot(c(b), c(b)))
    return F.when(norm > 0, dot(c(a), c(b)) / norm).otherwise(0.0)


#: The benchmark's wordings of an assignment, of a literal and of another variable.
ASSIGNMENTS = {
    "python": ("The following is one line of Python code to be executed in a Python interpreter:  `%s = '%s'`", "The following is one line of Python code to be executed in a Python interpreter:  `%s = %s`"),
    "javascript": ("Here is one line of JavaScript code to be executed in a JavaScript interpreter:  `var %s = '%s'`", "Here is one line of JavaScript code to be executed in a JavaScript interpreter:  `var %s = %s`"),
    "words": ("The special magic variable '%s' is equivalent to '%s'.", "The special magic variable '%s' is equivalent to '%s'."),
    "ruler": ("VAR %s = '%s'", "VAR %s = VAR %s"),
}


def assignment(var: Column, value: Column, style: str, literal: Column | None = None) -> Column:
    """A line that assigns a value to a variable, in one of four styles; ``literal`` tells whether it is a literal, as without it, or another variable's name."""
    if style not in ASSIGNMENTS:
        raise ValueError(f"style must be one of {sorted(ASSIGNMENTS)}")
    of_literal, of_variable = ASSIGNMENTS[style]
    return F.when(F.lit(True) if literal is None else literal, F.format_string(of_literal, var, value)).otherwise(F.format_string(of_variable, var, value))


def conversation_html(messages: Column | str) -> Column:
    """A conversation as HTML, a paragraph a message, with its signs escaped."""
    esc = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<p><b>"), m["role"], F.lit("</b>: "), esc(m["content"]), F.lit("</p>"))), "\n")
