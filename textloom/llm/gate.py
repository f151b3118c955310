"""Which words a text must hold for a regular expression to match, derived from the expression itself."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from re import _constants as C
from re import _parser

EDGE, GAP = "\x01", "\x02"  # a word boundary; anything, also nothing
RUN = re.compile(r"\w+")
OPEN = "~"  # marks a part of a word; no word holds it
MOST = 20_000  # strings that a pattern may be written out to


def _product(parts: Iterable[list[str]]) -> list[str]:
    out = [""]
    for part in parts:
        out = list(dict.fromkeys(a + b for a in out for b in part))
        if len(out) > MOST:
            raise ValueError("the pattern has too many alternatives")
    return out


def _strings(parsed) -> list[str]:  # noqa: ANN001
    """All that the pattern can match, with EDGE and GAP for what is no literal."""

    def one(op, value) -> list[str]:  # noqa: ANN001
        if op is C.LITERAL:
            return [chr(value)]
        if op is C.SUBPATTERN:
            return _strings(value[3])
        if op is C.BRANCH:
            return list(dict.fromkeys(s for branch in value[1] for s in _strings(branch)))
        if op is C.AT and value is C.AT_BOUNDARY:
            return [EDGE]
        if op is C.IN and all(kind is C.LITERAL for kind, _ in value):
            return [chr(c) for _, c in value]
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            if most <= 2:
                inside = _strings(inner)
                return list(dict.fromkeys(s for n in range(least, most + 1) for s in _product([inside] * n)))
        return [GAP]

    return _product(one(op, value) for op, value in parsed)


def needs(pattern: str) -> list[frozenset[str]]:
    """Sets of words; each match holds all words of one of them. Parts of words, where the pattern does
    not say how the word begins or ends, are marked with OPEN."""
    sets = set()
    for s in _strings(_parser.parse(pattern)):
        words = set()
        for m in RUN.finditer(s):
            before, after = s[: m.start()][-1:], s[m.end() :][:1]
            closed = before and before != GAP and after and after != GAP
            words.add(m.group() if closed else OPEN + m.group())
        sets.add(frozenset(words))
    least: list[frozenset[str]] = []
    for words in sorted(sets, key=len):
        if not any(a <= words for a in least):
            least.append(words)
    return least


class Gate:
    """Tells which of many patterns could match a text by its words alone; no pattern that matches is left out."""

    def __init__(self, patterns: list[str], rare: Callable[[str], object]) -> None:
        self.by_anchor: dict[str, list[tuple[int, frozenset[str]]]] = {}
        found = [(i, words) for i, p in enumerate(patterns) for words in needs(p)]
        if not all(words for _, words in found):
            raise ValueError("a pattern matches without any word")
        for i, words in found:
            self.by_anchor.setdefault(max(words, key=lambda w: (rare(w.removeprefix(OPEN)), len(w), w)), []).append((i, words))
        parts = {w.removeprefix(OPEN) for _, words in found for w in words if w.startswith(OPEN)}
        self.parts = [(OPEN + p, p) for p in sorted(parts)]
        self.vocabulary = frozenset(w for _, words in found for w in words)
        self.facts = functools.lru_cache(maxsize=300_000)(self._facts)

    def _facts(self, token: str) -> frozenset[str]:
        """The words of the patterns in a token without blanks, and the marked parts that it holds."""
        runs = RUN.findall(token)
        return self.vocabulary.intersection((*runs, *(mark for mark, part in self.parts if any(part in r for r in runs))))

    def anchored(self, token: str) -> bool:
        """Whether a text with this token is to be looked at; a text without such a token has no match."""
        return not self.by_anchor.keys().isdisjoint(self._facts(token))

    def open(self, tokens: Iterable[str], around: Iterable[str] = ()) -> set[int]:
        """The patterns that could match the tokens, joined by blanks, or them and those ``around`` with the telling word among the tokens."""
        own = frozenset().union(*map(self.facts, tokens))
        anchors = self.by_anchor.keys() & own
        words = own.union(*map(self.facts, around)) if anchors else own
        return {i for a in anchors for i, need in self.by_anchor[a] if need <= words}
