"""A small packrat engine for parsing-expression grammars.

An expression is a function (state, position) -> (end, value) or None. Named rules are memoised by rule, position and
argument, so parsing takes linear time; the argument carries the indentation of layout-sensitive languages.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Expression = Callable[["State", int], "tuple[int, object] | None"]


class State:
    """A text with the memo table of one parse."""

    def __init__(self, text: str):
        self.text, self.memo = text, {}


def rx(pattern: str, flags: int = 0) -> Expression:
    """A terminal; its value is the match."""
    match = re.compile(pattern, flags).match

    def parse(s, p):
        m = match(s.text, p)
        return (m.end(), m) if m else None

    return parse


def seq(*parts: Expression) -> Expression:
    """All parts in order; the value is the list of theirs."""

    def parse(s, p):
        values = []
        for part in parts:
            r = part(s, p)
            if r is None:
                return None
            p, v = r
            values.append(v)
        return p, values

    return parse


def choice(*options: Expression) -> Expression:
    """The first option that matches."""

    def parse(s, p):
        for option in options:
            r = option(s, p)
            if r is not None:
                return r
        return None

    return parse


def many(part: Expression, least: int = 0) -> Expression:
    """Greedy repetition; it stops where the part fails or consumes nothing."""

    def parse(s, p):
        values = []
        while (r := part(s, p)) is not None and r[0] > p:
            p = r[0]
            values.append(r[1])
        return (p, values) if len(values) >= least else None

    return parse


def opt(part: Expression) -> Expression:
    return lambda s, p: part(s, p) or (p, None)


def ahead(part: Expression) -> Expression:
    """And-predicate."""

    def parse(s, p):
        r = part(s, p)
        return None if r is None else (p, r[1])

    return parse


def absent(part: Expression) -> Expression:
    """Not-predicate."""
    return lambda s, p: (p, None) if part(s, p) is None else None


def act(part: Expression, action: Callable) -> Expression:
    """Semantic action: value becomes action(state, start, end, value)."""

    def parse(s, p):
        r = part(s, p)
        return None if r is None else (r[0], action(s, p, r[0], r[1]))

    return parse


def rule(name: str, body: Callable[..., Expression]) -> Callable[..., Expression]:
    """A memoised rule; body(*argument) gives its expression (built once per argument)."""
    built: dict = {}

    def make(*argument):
        def parse(s, p):
            key = (name, p, argument)
            if key not in s.memo:
                if argument not in built:
                    built[argument] = body(*argument)
                s.memo[key] = built[argument](s, p)
            return s.memo[key]

        return parse

    return make
