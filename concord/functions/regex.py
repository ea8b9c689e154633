"""Regex helpers.

The fixed patterns follow one dialect: Unicode word classes, `\\n` as the only line end, no implicit flags.
In Java that is the flag set below; `i` and `m` are added where a pattern needs them.
"""

from __future__ import annotations

import re._constants as _op
import re._parser as _parser
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = "(?dU)"
NOCASE = "(?idU)"
LINES = "(?dmU)"
NOCASE_LINES = "(?idmU)"


def matches(col: Column, pattern: str, flags: str = NOCASE) -> Column:
    return col.rlike(flags + pattern)


def folded(col: Column) -> Column:
    """Lower case as patterns without regard to case see it: four letters beyond ASCII count as ASCII ones there."""
    odd = reduce(lambda a, b: a | b, [F.contains(col, F.lit(c)) for c in "\u017f\u212a\u0131\u0130"])
    return F.lower(F.when(odd, F.translate(col, "\u017f\u212a\u0131\u0130", "skii")).otherwise(col))


@lru_cache(maxsize=None)
def needed_literals(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of lower-case literals: every match of the pattern contains a member of each set. At most two sets, those
    with the longest literals; none where the pattern needs no literal of two characters or more."""
    sets = sorted(_needed(_parser.parse(pattern)), key=lambda s: (-min(map(len, s)), len(s), sorted(s)))
    return tuple(s for s in sets if min(map(len, s)) >= 2)[:2]


def _needed(sequence) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*sequence, (None, None)]:
        if op is _op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            found.append(frozenset({run}))
            run = ""
        if op is _op.SUBPATTERN:
            found += _needed(value[-1])
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and value[0] >= 1:
            found += _needed(value[2])
        elif op is _op.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            if all(each):
                best = [max(sets, key=lambda s: (min(map(len, s)), -len(s))) for sets in each]
                found.append(frozenset().union(*best))
    return found


def guarded(lowered: str, col: Column, pattern: str, flags: str = NOCASE) -> Column:
    """The pattern's test, run only where the column named `lowered`, the folded text, contains the literals that every
    match needs.

    Finding a literal is a plain search of bytes, many times cheaper than a pattern that backtracks. The searches of a
    pattern are one SQL expression, so that a plan with hundreds of them is still quickly built.
    """
    test = matches(col, pattern, flags)
    there = _literals_sql(f"`{lowered}`", pattern)
    return F.expr(there) & test if there else test


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _literals_sql(lowered: str, pattern: str) -> str:
    return " AND ".join("(" + " OR ".join(f"contains({lowered}, {_quoted(x)})" for x in sorted(s)) + ")" for s in needed_literals(pattern))


def guarded_sql(lowered: str, text: str, pattern: str, flags: str = NOCASE) -> str:
    """`guarded` as SQL text, for tests inside a lambda; `lowered` and `text` are SQL expressions."""
    return " AND ".join(filter(None, [_literals_sql(lowered, pattern), f"{text} RLIKE {_quoted(flags + pattern)}"]))


def guarded_extract(lowered: str, col: Column, pattern: str, flags: str = NOCASE) -> Column:
    """`extract` of the whole match, run only where the column named `lowered` contains the literals that it needs."""
    there = _literals_sql(f"`{lowered}`", pattern)
    return extract(F.when(F.expr(there), col) if there else col, pattern, 0, flags)


def guarded_in(low: Column, col: Column, pattern: str, flags: str = NOCASE) -> Column:
    """`guarded` for a folded text that is no column by name, such as the variable of a lambda."""
    test = matches(col, pattern, flags)
    for literals in reversed(needed_literals(pattern)):
        test = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in sorted(literals)]) & test
    return test


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, although the body mentions it several times or in lambdas.

    A fold over no elements hands its start to the last step. Taking the one element of a transformed array would work out
    the type of the body, all its branches through, at every row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def extract(col: Column, pattern: str, group: int = 0, flags: str = NOCASE) -> Column:
    """The group of the first match, null when nothing matches."""
    hit = F.regexp_extract(col, flags + pattern, group)
    return F.when(hit != "", hit)


def sub(col: Column, pattern: str, replacement: str, flags: str = PLAIN) -> Column:
    return F.regexp_replace(col, flags + pattern, replacement)


def squeeze(col: Column) -> Column:
    return F.trim(sub(col, r"\s+", " "))


def kept(col: Column, letters: str) -> Column:
    """The runs of a class of characters, with a blank between two. Replacing its complement gives the same, but Java's
    regexes take some ten times as long over a negated class."""
    return F.array_join(F.regexp_extract_all(col, F.lit(f"[{letters}]+"), F.lit(0)), " ")


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return sub(col, r"^\s+|\s+$", "")


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def look_up(mapping: dict, key: Column) -> Column:
    """Value of a small fixed table for a key column, null when absent."""
    return F.try_element_at(literal_map(mapping), key)


def first_of(tests: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """An ordered decision list as one CASE expression."""
    chain = reduce(lambda acc, t: acc.when(t[0], t[1]), tests[1:], F.when(tests[0][0], tests[0][1]))
    return chain if otherwise is None else chain.otherwise(otherwise)
