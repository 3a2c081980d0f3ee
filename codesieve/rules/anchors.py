"""Literals that every match of a pattern must contain."""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

# Alternatives of one rule; a rule with more of them counts as one without literals.
MOST = 64


def anchors(pattern: str, least: int = 3) -> list[str]:
    """Lower-case ASCII literals of at least ``least`` characters, one of which every match contains; empty if there are none.

    Reads the parsed pattern: what stands in a row, or is repeated at least once, is needed; of alternatives each
    has to give literals of its own.  Of all that is needed the choice with the longest literals is taken.
    """
    best = _best(_parser.parse(pattern), least)
    return sorted(best) if best and len(best) <= MOST else []


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if not a or not b:
        return a or b
    return max(a, b, key=lambda c: (min(map(len, c)), -len(c)))


def _best(parsed, least: int) -> set[str] | None:
    best, run = None, ""

    def close() -> None:
        nonlocal best, run
        if len(run) >= least:
            best = _better(best, {run})
        run = ""

    for kind, value in parsed:
        if kind is op.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if kind is op.SUBPATTERN and all(k is op.LITERAL and v < 128 for k, v in value[3]):
            run += "".join(chr(v).lower() for _, v in value[3])  # a plain group goes on with the literal
            continue
        if kind is op.AT:
            continue  # an anchor or boundary takes no character
        close()
        if kind is op.SUBPATTERN:
            best = _better(best, _best(value[3], least))
        elif kind is op.ATOMIC_GROUP:
            best = _better(best, _best(value, least))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
            best = _better(best, _best(value[2], least))
        elif kind is op.BRANCH:
            each = [_best(b, least) for b in value[1]]
            if all(each):
                best = _better(best, set().union(*each))
    close()
    return best


def _items(parsed) -> list:
    """What a pattern has in a row, with the content of leading groups in place of them."""
    items = list(parsed)
    while items and items[0][0] is op.SUBPATTERN and not items[0][1][1] and not items[0][1][2]:
        items = [*items[0][1][3], *items[1:]]
    return items


def word_start(pattern: str) -> str | None:
    """The literal that every match starts with, if a match must start where a word does and that literal is the only anchor."""
    items, run = _items(_parser.parse(pattern)), ""
    if not items or items[0] != (op.AT, op.AT_BOUNDARY):
        return None
    for kind, value in _items(items[1:]):
        if kind is not op.LITERAL or value >= 128:
            break
        run += chr(value).lower()
    return run if re.match(r"\w", run) and anchors(pattern) == [run] else None


def within_word(pattern: str) -> bool:
    """Whether the pattern finds in a word, given with the characters around it, what it finds there in the whole text.

    All it takes must be characters of words, it must take something, and look-arounds see one character at most.  In doubt it is not.
    """
    parsed = _parser.parse(pattern)
    return parsed.getwidth()[0] > 0 and not parsed.state.flags & (re.S | re.X) and _within_word(parsed)


_PLACES = (op.AT_BOUNDARY, op.AT_NON_BOUNDARY, op.AT_BEGINNING, op.AT_END)


def _of_word(character: int) -> bool:
    return character < 128 and re.match(r"\w", chr(character)) is not None


def _within_word(parsed) -> bool:
    for kind, value in parsed:
        if kind is op.LITERAL:
            fine = _of_word(value)
        elif kind is op.IN:
            fine = all(k is op.LITERAL and _of_word(v) or k is op.RANGE and all(map(_of_word, range(v[0], min(v[1], 128) + 1)))
                       or k is op.CATEGORY and v in (op.CATEGORY_DIGIT, op.CATEGORY_WORD) for k, v in value)
        elif kind is op.AT:
            fine = value in _PLACES
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            fine = _within_word(value[2])
        elif kind is op.SUBPATTERN:
            fine = not value[1] and not value[2] and _within_word(value[3])
        elif kind is op.ATOMIC_GROUP:
            fine = _within_word(value)
        elif kind is op.BRANCH:
            fine = all(_within_word(b) for b in value[1])
        elif kind in (op.ASSERT, op.ASSERT_NOT):
            parts = value[1][0][1][1] if len(value[1]) == 1 and value[1][0][0] is op.BRANCH else [value[1]]
            fine = all(len(b) == 1 and (b[0][0] in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY) or b[0][0] is op.AT and b[0][1] in _PLACES) for b in parts)
        else:
            fine = False
        if not fine:
            return False
    return True


def problem(pattern: str | None) -> str | None:
    """Why a pattern cannot be used, or None."""
    try:
        if pattern is None:
            return "no pattern"
        return "matches the empty text" if re.compile(pattern).match("") else None
    except re.error as e:
        return f"pattern does not compile: {e}"
