"""Text helpers: decoding, lines, snippets, masks, short hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where Python's str.splitlines ends a line.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# A genuine U+FFFD in the input must survive; a noncharacter stands in for it.
_REPLACEMENT, _STAND_IN = "\ufffd", "\ufdd0"


def decode_utf8(content: Column) -> Column:
    """Bytes to text, dropping the bytes that are not valid UTF-8."""
    raw = content.cast("string")
    kept = F.replace(raw, F.lit(_REPLACEMENT), F.lit(_STAND_IN))
    valid = F.replace(F.make_valid_utf8(kept), F.lit(_REPLACEMENT), F.lit(""))
    return F.replace(valid, F.lit(_STAND_IN), F.lit(_REPLACEMENT))


def split_lines(text: Column) -> Column:
    """Lines as an array; a line break at the very end opens no further line."""
    pieces = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def snippet(lines: Column, line_number: Column, context: int = 2) -> Column:
    """The line with ``context`` lines around it, clipped to the file."""
    first = F.greatest(line_number - context, F.lit(1))
    last = F.least(line_number + context, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def line_number(text: Column, offset: Column) -> Column:
    """1 + the number of newlines before a zero-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def sha1_short(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 8)


def finding_id(rule_id: Column, file_path: Column, line: Column) -> Column:
    """Short id of a finding.  Path and line are hashed without a separator, so
    it is not unique; (scan, path, rule, line) is the real key."""
    return F.concat(F.lit("vuln-"), rule_id, F.lit("-"), sha1_short(F.concat(file_path, line.cast("string"))))


def mask_tail(value: Column, keep: int = 4) -> Column:
    """Stars for all but the last ``keep`` characters; all stars when shorter."""
    n = F.length(value)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.repeat(F.lit("*"), n - keep), F.right(value, F.lit(keep)))
    )


def mask_middle(value: Column) -> Column:
    """Bullets for the middle part, at most twelve; eight bullets when short."""
    n = F.length(value)
    return (
        F.when(value.isNull() | (n == 0), F.lit(""))
        .when(n <= 8, F.lit("\u2022" * 8))
        .otherwise(F.concat(
            F.left(value, F.lit(4)),
            F.repeat(F.lit("\u2022"), F.least(n - 8, F.lit(12))),
            F.right(value, F.lit(4)),
        ))
    )


def shannon_entropy(value: Column) -> Column:
    """Bits per character of a string."""
    n = F.length(value).cast("double")
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(
        F.array_distinct(F.split(value, "")),
        F.lit(0.0),
        lambda total, c: F.when(c == "", total).otherwise(total - share(c) * F.log2(share(c))),
    )


def json_value(value: Column) -> Column:
    """A scalar as JSON text (quoted and escaped)."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def html_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text
