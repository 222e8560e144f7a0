"""Boolean trigram queries of regular expressions, for an inverted index over lower-cased text."""

from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser

#: A query in disjunctive form: a text can match only if it has all trigrams of one of the sets. None: any text can.
Query = frozenset[frozenset[str]] | None
MAX_STRINGS, MAX_CLASS = 64, 6


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _any_of(queries: list[Query]) -> Query:
    return None if any(q is None for q in queries) else frozenset().union(*queries)


def _all_of(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x, y in product(a, b)) if len(a) * len(b) <= MAX_STRINGS else min(a, b, key=len)


def _of_strings(strings: set[str]) -> Query:
    return None if any(len(s) < 3 for s in strings) else frozenset(map(trigrams, strings))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """The strings that a node stands for if they are few, else None, and what any of its matches needs."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, None
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < MAX_CLASS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= MAX_CLASS else (None, None)
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and len(out := set().union(*(s for s, _ in parts))) <= MAX_STRINGS:
            return out, None
        return None, _any_of([_of_strings(s) if s is not None else q for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, query = _sequence(body)
        if strings is not None and most == 1:
            return strings | ({""} if not least else set()), None
        if not least:
            return None, None
        return None, _of_strings(strings) if strings is not None else query
    if op in (C.ASSERT, C.ASSERT_NOT, C.AT):
        return {""}, None
    return None, None


def _sequence(items) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, None, True
    for op, arg in items:
        more, needs = _node(op, arg)
        if more is not None and len(strings) * len(more) <= MAX_STRINGS:
            strings = {a + b for a, b in product(strings, more)}
            continue
        query, whole = _all_of(_all_of(query, _of_strings(strings)), needs), False
        strings = more if more is not None else {""}
    return (strings, None) if whole else (None, _all_of(query, _of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """What a lower-cased text must hold for pattern to match in the text."""
    strings, query = _sequence(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query
