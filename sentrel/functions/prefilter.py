"""Literals a pattern cannot match without.

A regex costs microseconds per line, a substring test nanoseconds. From each pattern we
derive a small set of lower-case strings of which every matching line contains at least
one, so most lines skip the regex. The exact pattern still decides every hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # modules of the interpreter that may move; without them every gate stays open
    from re import _constants as op
    from re import _parser as parser
except ImportError:
    op = parser = None

MAX_SET = 24  # a larger set of alternatives is not worth testing
#: Per cent of the letters of English text; other characters count as 1.
FREQUENCY = {
    " ": 18.0, "e": 12.7, "t": 9.1, "a": 8.2, "o": 7.5, "i": 7.0, "n": 6.7, "s": 6.3, "h": 6.1, "r": 6.0, "d": 4.3, "l": 4.0, "c": 2.8,
    "u": 2.8, "m": 2.4, "w": 2.4, "f": 2.2, "g": 2.0, "y": 2.0, "p": 1.9, "b": 1.5, "v": 1.0, "k": 0.8, "j": 0.15, "x": 0.15, "q": 0.1, "z": 0.07,
}


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The more selective of two requirements: longer shortest member, then fewer members."""
    if a is None or b is None:
        return b if a is None else a
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _usable(strings: frozenset[str] | None) -> frozenset[str] | None:
    return strings if strings and "" not in strings and len(strings) <= MAX_SET else None


def _walk(items) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """(all strings the items can match, or None; a required set, or None)."""
    run: frozenset[str] = frozenset({""})
    exact: frozenset[str] | None = frozenset({""})
    best: frozenset[str] | None = None
    for code, value in items:
        node_exact, node_best = None, None
        if code is op.LITERAL:
            node_exact = frozenset({chr(value).lower()})
        elif code is op.IN and all(c is op.LITERAL for c, _ in value):
            node_exact = frozenset(chr(v).lower() for _, v in value)
        elif code is op.SUBPATTERN:
            node_exact, node_best = _walk(value[3])
        elif code is op.BRANCH:
            parts = [_walk(branch) for branch in value[1]]
            if all(p[0] is not None for p in parts):
                node_exact = frozenset().union(*[p[0] for p in parts])
            choices = [_usable(p[0]) or p[1] for p in parts]
            if all(choices):
                node_best = frozenset().union(*choices)
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            inner_exact, inner_best = _walk(inner)
            if high == 1 and inner_exact is not None:
                node_exact = inner_exact | (frozenset({""}) if low == 0 else frozenset())
            elif low >= 1:
                node_best = _better(inner_best, _usable(inner_exact))
        elif code is op.AT:
            node_exact = frozenset({""})  # a position, no text
        joined = None
        if node_exact is not None:
            joined = frozenset(a + b for a in run for b in node_exact)
        if joined is not None and len(joined) <= MAX_SET:
            run = joined
        else:
            best = _better(best, _usable(run))
            run = node_exact if node_exact is not None and len(node_exact) <= MAX_SET else frozenset({""})
        exact = None if exact is None or node_exact is None else frozenset(a + b for a in exact for b in node_exact)
        if exact is not None and len(exact) > MAX_SET:
            exact = None
        best = _better(best, _usable(node_best))
    return exact, _better(best, _usable(run))


@lru_cache(maxsize=4096)
def required_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which a matching text contains one; empty when none is certain."""
    if parser is None:
        return ()
    found = _walk(parser.parse(pattern))[1]
    if not found or min(map(len, found)) < 2:
        return ()
    # A member that contains another one adds nothing.
    return tuple(sorted(s for s in found if not any(o != s and o in s for o in found)))


def may_match(lowered: Column, pattern: str) -> Column:
    """A cheap test that is true for every line the pattern matches."""
    test: Column | None = None
    for literal in required_literals(pattern):
        found = F.contains(lowered, F.lit(literal))
        test = found if test is None else test | found
    return F.lit(True) if test is None else test


def any_of_regex(literals: list[str]) -> str:
    """One regex that finds any of the strings, with shared beginnings written once."""
    heads: dict[str, list[str]] = {}
    for literal in sorted(set(literals)):
        heads.setdefault(literal[:1], []).append(literal[1:])
    if "" in heads:
        return ""  # a string ends here, the longer ones need not be told apart
    branches = [re.escape(head) + any_of_regex(tails) for head, tails in heads.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def anchored_regex(literals: list[str]) -> str:
    """One regex that finds any of the strings, and tries them only at the few characters of which each holds one.

    The characters are chosen for being rare in text and shared by many of the strings; what stands before one is looked behind for.
    """
    left, anchors = set(literals), {}
    while left:
        gain = lambda c: (sum(c in literal for literal in left) / FREQUENCY.get(c, 1.0), c)
        anchor = max({c for literal in left for c in literal}, key=gain)
        anchors[anchor] = sorted(literal for literal in left if anchor in literal)
        left.difference_update(anchors[anchor])
    branches = []
    for anchor, held in anchors.items():
        heads: dict[str, list[str]] = {}
        for literal in held:
            at = literal.index(anchor)
            heads.setdefault(literal[: at + 1] if at else "", []).append(literal[at + 1 :])
        ways = [(f"(?<={re.escape(head)})" if head else "") + any_of_regex(tails) for head, tails in heads.items()]
        branches.append(f"{re.escape(anchor)}(?:{'|'.join(ways)})")
    return f"(?=[{''.join(map(_in_set, anchors))}])(?:{'|'.join(branches)})"


def _in_set(char: str) -> str:
    """A character inside ``[...]`` of the engine's dialect."""
    return char if char.isalnum() else re.escape(char) if re.escape(char) != char or not char.isascii() else f"\\{char}"


def line_gate(lowered: Column, patterns: list[str]) -> Column:
    """False only for lines that none of the patterns can match."""
    needed = [required_literals(pattern) for pattern in patterns]
    if not needed or not all(needed):
        return F.lit(True)
    return lowered.rlike(anchored_regex([literal for literals in needed for literal in literals]))


def _always(items, char: str) -> bool:
    """Whether every text that the items match holds the character."""
    for code, value in items:
        if code is op.LITERAL:
            found = chr(value) == char
        elif code is op.SUBPATTERN:
            found = _always(value[3], char)
        elif code is op.BRANCH:
            found = all(_always(branch, char) for branch in value[1])
        else:
            found = code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1 and _always(value[2], char)
        if found:
            return True
    return False


def call_gate(lowered: Column, patterns: Iterable[str]) -> Column:
    """False only for lines that none of the patterns can match; a pattern of calls asks for ``(`` only."""
    needed: set[str] = set()
    for pattern in patterns:
        try:
            literals = ("(",) if parser is not None and _always(parser.parse(pattern), "(") else required_literals(pattern)
        except re.error:  # a pattern of the engine's dialect only
            literals = ()
        if not literals:
            return F.lit(True)
        needed.update(literals)
    return lowered.rlike(anchored_regex(sorted(needed))) if needed else F.lit(False)
