"""Package names and versions as comparable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of a word inside a version.  "E" ends a release and "N" is a number, so
# 1.0.dev1 < 1.0a1 < 1.0b1 < 1.0rc1 < 1.0 < 1.0.post1 < 1.0.1.
_WORD_RANK = {
    "dev": "A0", "a": "A1", "alpha": "A1", "b": "A2", "beta": "A2",
    "c": "A3", "rc": "A3", "pre": "A3", "preview": "A3",
    "post": "F", "rev": "F", "r": "F",
}


def normal_name(ecosystem: Column, name: Column) -> Column:
    """PyPI ignores case and treats runs of ``-``, ``_`` and ``.`` as one dash."""
    pypi = F.regexp_replace(F.lower(name), r"[-_.]+", "-")
    return F.when(F.lower(ecosystem) == "pypi", pypi).otherwise(name)


# Ecosystems whose versions are semantic versions; Go's pseudo-versions are such pre-releases.
_SEMANTIC = ("npm", "go", "crates.io", "hex", "pub")

# Maven's qualifiers around the release, "E"; others follow in alphabetical order.
_MAVEN_RANK = {"alpha": "A0", "beta": "A1", "milestone": "A2", "rc": "A3", "cr": "A3", "snapshot": "A4",
               "final": "E", "ga": "E", "release": "E", "sp": "F0"}


def version_key(version: Column, ecosystem: Column | None = None) -> Column:
    """Text that sorts as the version does in its ecosystem; null if it does not start with a digit.

    npm, Go, crates.io, Hex and Pub sort as semantic versions do, NuGet likewise with up to four numbers and any case, Maven by
    its ranks of qualifiers, RubyGems with letters below numbers.  All others are dotted numbers with pre-, post- and
    development tags and an epoch before ``!``; what follows ``+`` is ignored and trailing zero components do not count.
    """
    key = _dotted_key(version)
    if ecosystem is None:
        return key
    eco = F.lower(ecosystem)
    return (F.when(eco.isin(*_SEMANTIC), _semantic_key(version)).when(eco == "nuget", _semantic_key(F.lower(version), 4))
            .when(eco == "maven", _maven_key(version)).when(eco == "rubygems", _gem_key(version)).otherwise(key))


def _number(digits: Column) -> Column:
    """Digits with their length in front, so that they sort as numbers."""
    short = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    return F.concat(F.lpad(F.length(short).cast("string"), 3, "0"), short)


def _semantic_key(version: Column, width: int = 3) -> Column:
    """``width`` numbers, then "A" and the identifiers of a pre-release, or "E": a pre-release lies below its
    release, numeric identifiers below others, fewer below more.  Build metadata is ignored."""
    plain = F.regexp_replace(F.substring_index(F.trim(version), "+", 1), r"^[v=\s]+", "")
    core = F.regexp_extract(plain, r"^[0-9]+(?:\.[0-9]+)*", 0)
    tag = F.regexp_replace(F.substring(plain, F.length(core) + 1, F.length(plain)), "^[-.]", "")
    given = F.split(core, r"\.")
    numbers = F.concat(given, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), width - F.size(given))))
    names = F.transform(F.split(tag, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x)))
    key = F.concat_ws(" ", F.transform(numbers, lambda x: F.concat(F.lit("N"), _number(x))), F.when(tag == "", F.lit("E")).otherwise(F.concat_ws(" ", F.lit("A"), names)))
    return F.when(core != "", key)


def _dotted_key(version: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.substring_index(F.trim(version), "+", 1)), r"^v", "")
    epoch = F.regexp_extract(plain, r"^0*([1-9][0-9]*)!", 1)
    plain = F.regexp_replace(plain, r"^[0-9]+!", "")
    core = F.regexp_replace(plain, r"\.0[.0]*($|[-_.]?[a-z]|[^0-9.])", "$1")
    words = F.create_map(*[F.lit(x) for item in _WORD_RANK.items() for x in item])

    def component(part: Column) -> Column:
        word = F.coalesce(F.try_element_at(words, part), F.concat(F.lit("A4"), part))
        return F.when(part.rlike("^[0-9]"), F.concat(F.lit("N"), _number(part))).otherwise(word)

    parts = F.transform(F.regexp_extract_all(core, F.lit("([0-9]+|[a-z]+)"), F.lit(1)), component)
    key = F.concat_ws(" ", F.when(epoch != "", F.concat(F.lit("Z"), _number(epoch))), F.array_append(parts, F.lit("E")))
    return F.when(plain.rlike("^[0-9]"), key)


def _maven_key(version: Column) -> Column:
    """Tokens between dots, dashes and changes from digits to letters.  A number behind a dot lies above one behind a
    dash, and any number above any qualifier.  What stands for nothing (0, final, ga, release) goes where nothing or a qualifier follows."""
    plain = F.regexp_replace(F.lower(F.trim(version)), "(?<![a-z])(a|b|m)(?=[0-9])", "$1#")
    for short, long in (("a#", "alpha"), ("b#", "beta"), ("m#", "milestone")):
        plain = F.replace(plain, F.lit(short), F.lit(long))
    core = F.regexp_replace(plain, r"(?:[.-](?:0+(?![0-9])|(?:final|ga|release)(?![a-z0-9])))+(?=$|-|\.?[a-z])", "")
    ranks = F.create_map(*[F.lit(x) for item in _MAVEN_RANK.items() for x in item])

    def token(t: Column) -> Column:
        word = F.regexp_replace(t, "^[.-]", "")
        number = F.concat(F.when(F.startswith(t, F.lit(".")), F.lit("N")).otherwise(F.lit("M")), _number(word))
        return F.when(word.rlike("^[0-9]"), number).otherwise(F.coalesce(F.try_element_at(ranks, word), F.concat(F.lit("F1"), word)))

    tokens = F.transform(F.regexp_extract_all(F.concat(F.lit("."), core), F.lit("([.-]?(?:[0-9]+|[^0-9.-]+))"), F.lit(1)), token)
    return F.when(plain.rlike("^[0-9]"), F.concat_ws(" ", F.array_append(tokens, F.lit("E"))))


def _gem_key(version: Column) -> Column:
    """Runs of digits and of letters; letters lie below the end and numbers above it, and a dash starts a pre-release."""
    plain = F.replace(F.trim(version), F.lit("-"), F.lit(".pre."))
    core = F.regexp_replace(plain, r"(?:\.0+(?![0-9]))+(?=$|\.?[A-Za-z])", "")
    parts = F.transform(F.regexp_extract_all(core, F.lit("([0-9]+|[A-Za-z]+)"), F.lit(1)),
                        lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("N"), _number(p))).otherwise(F.concat(F.lit("A"), p)))
    return F.when(plain.rlike("^[0-9]"), F.concat_ws(" ", F.array_append(parts, F.lit("E"))))
