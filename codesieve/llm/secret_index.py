"""Secret scans over a trigram inverted index.

Every rule is a regular expression.  What it must contain is derived as a Boolean query of trigrams; postings
(trigram, document) are kept for the trigrams that some rule asks for, and a rule is verified only on documents that its
query leaves.  Rules without mandatory trigrams are run on every text.  Only built-in functions: no Python on the
executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A query in conjunctive form: all of these sets must have a member all of whose trigrams occur.
Query = list[frozenset[frozenset[str]]]

# More strings than this are not followed through a pattern, nor character classes with more members.
MOST_STRINGS, MOST_MEMBERS = 64, 8


@dataclass(frozen=True)
class SecretRule:
    """A match of ``pattern`` counts if its group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules; their patterns are fixed by the contract.
BASE_RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
)
# Further public token formats.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("slack", r"xox[abprs]-[0-9A-Za-z-]+", 0, 20),
)
RULES = BASE_RULES + MORE_RULES


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _flush(strings: set[str], query: Query) -> None:
    if strings and all(len(s) >= 3 for s in strings):
        choices = {trigrams(s) for s in strings}
        query.append(frozenset(c for c in choices if not any(other < c for other in choices)))  # a choice that implies another says nothing


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(the strings that a part of a pattern can match, if these are few; what any match must contain)."""
    strings, query, exact = {""}, [], True
    for op, arg in nodes:
        name, few = str(op), None
        if name == "LITERAL":
            few = {chr(arg).lower()}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            ranges = [(a, a) if str(o) == "LITERAL" else a for o, a in arg]
            if sum(b - a + 1 for a, b in ranges) <= MOST_MEMBERS:
                few = {chr(c).lower() for a, b in ranges for c in range(a, b + 1)}
        elif name == "SUBPATTERN":
            few, more = _walk(arg[3])
            query += more
        elif name == "BRANCH":
            parts = [_walk(part) for part in arg[1]]
            if all(s is not None for s, _ in parts):
                few = set().union(*(s for s, _ in parts))
            elif all(q for _, q in parts):
                # one of the branches holds: of each the first condition is kept
                query.append(frozenset().union(*(q[0] for _, q in parts)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            some, more = _walk(inner)
            if low:
                query += more
            if some is not None and high == 1:
                few = some | ({""} if not low else set())
            elif some is not None and low and len(strings) * len(some) <= MOST_STRINGS:
                strings = {a + b for a, b in product(strings, some)}  # it starts with one of these
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if few is not None and len(strings) * len(few) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, few)}
        else:
            _flush(strings, query)
            strings, exact = set(few) if few is not None and len(few) <= MOST_STRINGS else {""}, False
    if exact:
        return strings, query
    _flush(strings, query)
    return None, query


def trigram_query(pattern: str) -> Query:
    """What every match of a pattern contains, in lower case; an empty query says nothing (the rule scans fully)."""
    strings, query = _walk(re._parser.parse(pattern))
    if strings is not None:
        _flush(strings, query)
    return query


def _holds(query: Query, found: Column) -> Column:
    every = F.lit(True)
    for choice in query:
        any_ = F.lit(False)
        for needed in choice:
            any_ = any_ | (F.size(F.array_intersect(found, F.array(*(F.lit(t) for t in sorted(needed))))) == len(needed))
        every = every & any_
    return every


def postings(docs: DataFrame, wanted: list[str], key: str = "key", text: str = "text") -> DataFrame:
    """The inverted index of ``wanted`` trigrams: (trigram, key), one row for every trigram that a text holds, case ignored."""
    low = docs.select(key, F.lower(text).alias("_low"))
    held = F.array_compact(F.array(*(F.when(F.col("_low").contains(t), F.lit(t)) for t in wanted)))
    return low.select(key, F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query], key: str = "key") -> DataFrame:
    """(key, kinds): the rules whose trigram query a document's postings meet; documents that meet none are left out.

    Intersecting is a sum by document over the postings, of which there are at most as many per document as trigrams are asked for.
    """
    found = index.groupBy(key).agg(F.collect_set("trigram").alias("_found"))
    kinds = F.array_compact(F.array(*(F.when(_holds(q, F.col("_found")), F.lit(k)) for k, q in queries.items())))
    return found.select(key, kinds.alias("kinds")).where(F.size("kinds") > 0)


def find(text: Column, rule: SecretRule, number: int) -> Column:
    """All spans of a rule in a text as structs (start, number, end), leftmost and non-overlapping, in code points.

    The matches and the texts between them are cut out, and their lengths added up.
    """
    pattern = F.lit(rule.pattern)
    matches, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    rows = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(sized, F.length).alias("tested"))
    empty = F.lit([]).cast("array<struct<start:int,number:int,end:int>>")

    def step(acc, row):
        start, end = acc["at"] + row["gap"], acc["at"] + row["gap"] + row["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"))
        kept = F.coalesce(row["tested"] >= rule.least, F.lit(False))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(kept, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(empty)


def scan(df: DataFrame, rules: tuple[SecretRule, ...] = RULES, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
         found: str = "found") -> DataFrame:
    """The ``carry`` columns, the text, and ``found`` (under that name): its spans (start, number of the rule, end) sorted by start, then rule.

    One row per input row: null texts are empty ones, and empty texts have no spans; null ids and repeated rows
    are kept.  Texts are scanned whole.  A document is known by the hash of its columns and text, so equal rows
    share their postings, and a collision could only add a candidate.  Columns that are not carried may have any names.

    Postings are narrow and summed before the shuffle; the texts are shuffled once, to meet their candidates.
    """
    held = [f"_{i}" for i in range(len(carry))]
    docs = df.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(carry, held)), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64(*held, "text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    full = {k for k, q in queries.items() if not q}
    queries = {k: q for k, q in queries.items() if q}
    wanted = sorted({t for q in queries.values() for choice in q for needed in choice for t in needed})
    if queries:
        docs = docs.join(candidates(postings(docs, wanted), queries), "key", "left")
    else:
        docs = docs.withColumn("kinds", F.array().cast("array<string>"))
    empty = F.lit([]).cast("array<struct<start:int,number:int,end:int>>")
    spans = [find(F.col("text"), r, i) if r.kind in full
             else F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), find(F.col("text"), r, i)).otherwise(empty)
             for i, r in enumerate(rules)]
    return docs.select(*(F.col(h).alias(c) for c, h in zip(carry, held)), "text", F.array_sort(F.concat(*spans)).alias(found))


def joined(found: Column, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """``kind:start:end`` of spans, comma-joined in their order."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every run of overlapping spans replaced by a mark."""
    merged = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("parts")), lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["parts"])
        .otherwise(F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("parts")),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, merged).otherwise(text)
