"""Find every match of many patterns in a column of texts, with line numbers.

The work is done in two steps, both of built-in expressions and without a
shuffle:

1. *Gate*: one expression tests each rule on each text (language, then required
   literals, then the regular expression) and keeps the numbers of the rules
   that match somewhere.  Texts without any match end here.
2. *Locate*: for each (text, rule) left, one ``regexp_replace`` puts a marker
   character before every match; splitting the marked text at newlines then
   gives the line of each match as the position of its piece.

A text is processed whole and by itself, so results do not depend on how texts
are spread over partitions.

Rules with an open ``.*`` would look for its end from every start to the end of the line, which takes
quadratic time on long lines.  Where the line holds no such end any more, a stop is put before every further start (in
a copy of the text), and ``.`` does not match stops: each search ends at the next start.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..rules.model import TextRule

# Markers put into a copy of the text: Unicode noncharacters, which no text is
# meant to hold.  Should one occur, it is first replaced by another one.
_HIT, _VALUE_END, _PLAIN = "\ufdd1", "\ufdd2", "\ufdd3"
# Stops of the first, second and further open searches of a rule.
_STOPS = "\ufdd4\ufdd5\ufdd6\ufdd7"

_OVER_STOPS = {
    r"\s*": rf"[\s\x1c-\x1f{_STOPS}]*",
    r"\s+": rf"[{_STOPS}]*[\s\x1c-\x1f][\s\x1c-\x1f{_STOPS}]*",
    r"\w+": rf"\w[\w{_STOPS}]*",
}

# Characters that equal an ASCII letter when case is ignored but do not
# lower-case to it, so that a literal test on the lower-cased text misses them.
_CASE_TWINS = ("\u0130", "\u0131", "\u017f", "\u212a")


def java_pattern(rule: TextRule) -> str:
    """The rule's pattern with the flags that give it its meaning in Java.

    ``d``: only a newline ends a line; ``m``: multi-line anchors; ``i``/``u``:
    Unicode case folding; ``U``: Unicode classes.  The four ASCII separators
    count as white space, as they do for Python strings.
    """
    pattern = rule.pattern
    for _, end, *absent in rule.ends:
        if absent:  # a stop behind a word is no end of the word: the start that it stands before goes on with it
            pattern = pattern.replace(end, f"{end}(?![{_STOPS}])")
    return _flags(rule) + _widen_space(pattern, stops=len(rule.ends))


def _flags(rule: TextRule) -> str:
    return "(?dmuU" + ("i" if rule.ignore_case else "") + ")"


def with_stops(text: Column, rule: TextRule) -> Column:
    """The text with the stops of a rule's open searches; the text itself if it has none.

    Line by line: up to the last possible end of a search nothing changes; behind it, each start gets a stop.  An end that may go on in
    the next line counts as possible.  Where the end is one that must not come, starts before it cannot match and are taken out.  A line with one start is searched once, so only texts where some line holds
    two are copied at all.
    """
    def stopping(start: str, end: str, stop: str, absent: bool):
        def stopped(line: Column) -> Column:
            live = F.regexp_extract(line, f"{_flags(rule)}^.*(?:{_widen_space(end)})", 0)
            dead = F.substring(line, F.length(live) + 1, F.length(line))
            if absent:
                live = F.regexp_replace(live, f"{_flags(rule)}{start}", _PLAIN)
            return F.concat(live, F.regexp_replace(dead, f"{_flags(rule)}(?={start})", stop))
        return stopped

    for (start, end, *absent), stop in zip(rule.ends, _STOPS):
        several = text.rlike(f"{_flags(rule)}(?={start})[^\n]+(?={start})")
        text = F.when(several, F.array_join(F.transform(F.split(text, "\n", -1), stopping(start, end, stop, bool(absent))), "\n")).otherwise(text)
    return text


def _widen_space(pattern: str, stops: int = 0) -> str:
    """``\\s`` with the ASCII separators; with ``stops``, ``.*`` ends at them, one for each in turn, while
    white space and words that go on from an earlier line pass over them."""
    out, in_class, i, seen = [], False, 0, 0
    while i < len(pattern):
        pair = pattern[i:i + 2]
        if stops and not in_class and pattern[i:i + 3] in _OVER_STOPS:
            out.append(_OVER_STOPS[pattern[i:i + 3]])
            i += 3
            continue
        if pair[0] == "\\":
            space = pair == r"\s"
            out.append((r"\s\x1c-\x1f" if in_class else r"[\s\x1c-\x1f]") if space else pair)
            i += 2
            continue
        if pair[0] == "[":
            in_class = True
        elif pair[0] == "]":
            in_class = False
        if pair == ".*" and not in_class and seen < stops:
            out.append(f"[^\\n{_STOPS[seen]}]")
            seen += 1
        else:
            out.append(pair[0])
        i += 1
    return "".join(out)


def _literal_test(rule: TextRule, lowered: Column, has_twins: Column) -> Column | None:
    if not rule.requires:
        return None
    groups = [reduce(or_, [F.contains(lowered, F.lit(lit.encode())) for lit in group]) for group in rule.requires]
    return reduce(and_, groups) | has_twins


def _gate_column(rules: Sequence[TextRule], text: Column, lowered: Column, has_twins: Column,
                 language: Column | None, wanted: Sequence[Column] | None = None) -> Column:
    tests = []
    for number, rule in enumerate(rules):
        parts = [wanted[number]] if wanted else []
        if "any" not in rule.languages:
            if language is None:
                raise ValueError(f"rule {rule.rule_id} is for some languages only; name the language column")
            parts.append(language.isin(*rule.languages))
        literal = _literal_test(rule, lowered, has_twins)
        if literal is not None:
            parts.append(literal)
        parts.append(with_stops(text, rule).rlike(java_pattern(rule)))
        tests.append(F.when(reduce(and_, parts), F.lit(number)))
    # ``filter`` keeps this wide expression out of the fused stage, whose one
    # generated method would grow past the size the JIT compiler accepts
    # (measured: about a third slower with dozens of rules).
    return F.filter(F.array(*tests), lambda number: number.isNotNull())


def gate(files: DataFrame, rules: Sequence[TextRule], text: str = "code",
         language: str | None = None, wanted: Sequence[Column] | None = None) -> DataFrame:
    """One row per (file, rule) that matches, plus ``rule_no``: its place in ``rules``.

    ``wanted`` says for each rule whether the row asks for it; it is tested before anything else of the rule.

    Missing and empty texts match nothing, since no rule matches the empty text.

    The test array goes straight into ``explode``.  As a column of its own the
    optimizer would infer a "not empty" filter from it, push that below the
    projection and run every test twice.
    """
    lowered, twins = "__lower", "__twins"
    twin_test = reduce(or_, [F.contains(F.col(text), F.lit(c)) for c in _CASE_TWINS])
    prepared = (
        # As bytes: the search is about a third faster than on strings.
        files.withColumn(lowered, F.lower(F.col(text)).cast("binary"))
        .withColumn(twins, twin_test)
    )
    tests = _gate_column(
        rules, _without_markers(F.col(text)), F.col(lowered), F.col(twins), F.col(language) if language else None, wanted
    )
    return prepared.select(*files.columns, F.explode(tests).alias("rule_no"))


def _by_rule(values: Sequence[str]) -> Column:
    """The row's entry of a per-rule list of texts."""
    if len(set(values)) == 1:
        return F.lit(values[0])
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule_no") + 1)


def _without_markers(text: Column) -> Column:
    markers = _HIT + _VALUE_END + _STOPS
    has_marker = text.rlike(f"[{markers}]")
    return F.when(has_marker, F.translate(text, markers, _PLAIN * len(markers))).otherwise(text)


def locate(files: DataFrame, rules: Sequence[TextRule], text: str = "code",
           language: str | None = None, keep_lines: bool = False, wanted: Sequence[Column] | None = None) -> DataFrame:
    """One row per (file, rule, line) with a match.

    Adds ``rule_no`` (position in ``rules``), ``line_number`` and ``line_marked``,
    the line with its matches marked (see :func:`hit_count` and :func:`hit_values`).
    The text itself is dropped here; ``keep_lines`` leaves it as an array
    ``lines``, split once per (file, rule) and not once per match.
    """
    gated = gate(files, rules, text, language, wanted)
    keys = [c for c in files.columns if c not in (text, language)]
    replacements = [
        f"{_HIT}${r.value_group}{_VALUE_END}$0" if r.value_group else f"{_HIT}$0" for r in rules
    ]
    prepared = _without_markers(F.col(text))
    for number, rule in enumerate(rules):
        if rule.ends:
            prepared = F.when(F.col("rule_no") == number, with_stops(_without_markers(F.col(text)), rule)).otherwise(prepared)
    marked = F.regexp_replace(
        prepared,
        _by_rule([java_pattern(r) for r in rules]),
        _by_rule(replacements),
    )
    kept = gated.select(
        *keys, "rule_no", marked.alias("__marked"), *([split_lines(F.col(text)).alias("lines")] if keep_lines else [])
    )
    lines = kept.select(
        *[c for c in kept.columns if c != "__marked"],
        F.posexplode(F.split("__marked", "\n", -1)).alias("__pos", "line_marked"),
    )
    return (
        lines.where(F.contains(F.col("line_marked"), F.lit(_HIT)))
        .withColumn("line_number", F.col("__pos") + 1)
        .drop("__pos")
    )


def hit_count(marked: Column) -> Column:
    """Number of matches that start on a marked line."""
    return F.length(marked) - F.length(F.replace(marked, F.lit(_HIT), F.lit("")))


def hit_values(marked: Column) -> Column:
    """The reported values of a marked line's matches, in order."""
    pieces = F.split(marked, _HIT, -1)
    return F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p: F.substring_index(p, _VALUE_END, 1)
    )
