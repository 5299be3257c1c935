"""Matching of many patterns: an automaton of literals that each pattern needs picks the few that are tried.

A pattern's parse tree tells texts of which one at least stands in whatever it matches. All such texts of all patterns go
into one Aho-Corasick automaton; one pass over a value finds them, and only patterns of which a text is found are tried, as
well as those that need none. So the cost of a value grows with what it holds, not with the number of patterns.
"""

from __future__ import annotations

import re
import re._constants as codes
import re._parser as parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives of a pattern that are followed at most; a pattern with more is always tried.
MOST_TEXTS = 64


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The more telling of two sets: its shortest text is longer, or it has fewer."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _needed(tree) -> set[str] | None:
    best: set[str] | None = None
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is codes.LITERAL:
            run += chr(arg)
            continue
        if run:
            best, run = _better(best, {run}), ""
        inner = None
        if op is codes.SUBPATTERN:
            _, added, _, body = arg
            inner = None if added & re.IGNORECASE else _needed(body)
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = _needed(arg[2])
        elif op is codes.ATOMIC_GROUP:
            inner = _needed(arg)
        elif op is codes.BRANCH:
            each = [_needed(branch) for branch in arg[1]]
            inner = set().union(*each) if all(each) else None
        elif op is codes.ASSERT and arg[0] >= 0:
            inner = _needed(arg[1])
        if inner and len(inner) <= MOST_TEXTS:
            best = _better(best, inner)
    return best


def needed_texts(pattern: str) -> set[str] | None:
    """Texts of which every match of ``pattern`` holds one, or None if the parse tree names none (case is ignored, or
    everything is optional)."""
    tree = parser.parse(pattern)
    return None if tree.state.flags & re.IGNORECASE else _needed(tree)


class Matcher:
    """The modules of all rules ``(module, pattern)`` whose pattern is found in a value, in rule order, each once."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = [(m, re.compile(p)) for m, p in rules]
        self.always: list[int] = []
        of: dict[str, list[int]] = {}
        for n, (_, p) in enumerate(rules):
            texts = needed_texts(p)
            for t in texts or ():
                of.setdefault(t, []).append(n)
            if not texts:
                self.always.append(n)
        self.automaton = ahocorasick.Automaton()
        for t, numbers in of.items():
            self.automaton.add_word(t, numbers)
        if of:
            self.automaton.make_automaton()
        self.tried = 0

    def __call__(self, value: str | None) -> list[str]:
        if not value:
            return []
        numbers = set(self.always)
        if len(self.automaton):
            for _, found in self.automaton.iter(value):
                numbers.update(found)
        self.tried += len(numbers)
        return list(dict.fromkeys(m for m, p in (self.rules[n] for n in sorted(numbers)) if p.search(value)))


def modules_found(value: Column, rules: list[tuple[str, str]]) -> Column:
    """``array<string>``: what :class:`Matcher` gives for each value, empty for null and for the empty text.

    The rules are a stated set, which goes to the tasks with the function; equal values of a batch are matched once.
    """
    made: list[Matcher] = []

    @F.pandas_udf("array<string>")
    def found(values: pd.Series) -> pd.Series:
        if not made:
            made.append(Matcher(rules))
        return values.map({v: made[0](v) for v in values.unique()}) if len(values) else values

    return found(value)
