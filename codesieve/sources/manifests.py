"""Dependency manifests as rows of (name, version, ecosystem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines

# Fixed values, tried in this order: the first that occurs anywhere in the line splits it.
SEPARATORS = ("==", ">=", "<=", "~=", "!=", ">", "<")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


# What counts as white space in Python's strings.
WHITE_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _strip(text: Column) -> Column:
    """As ``str.strip``: a search by a pattern at every character of a line took most of the time of a manifest."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def flag_empty_requirements(manifests: DataFrame, content: str = "content") -> DataFrame:
    """Add ``reason`` for manifests that name no package; a test inside the row."""
    def names_package(line: Column) -> Column:
        stripped = _strip(line)
        return (stripped != "") & ~stripped.rlike("^[#-]")
    named = F.coalesce(F.exists(split_lines(F.col(content)), names_package), F.lit(False))
    return manifests.withColumn("reason", F.when(~named, "No packages found in requirements file"))


def parse_requirements(manifests: DataFrame, content: str = "content") -> DataFrame:
    """requirements.txt texts to one row per package, in file order (``ordinal``)."""
    keys = [c for c in manifests.columns if c != content]
    lines = (
        manifests.select(*keys, F.posexplode(split_lines(F.col(content))).alias("ordinal", "__raw"))
        .withColumn("__line", _strip(F.col("__raw")))
        .where((F.col("__line") != "") & ~F.col("__line").rlike("^[#-]"))
    )
    line = F.col("__line")
    separator = F.coalesce(*[F.when(F.contains(line, F.lit(s)), F.lit(s)) for s in SEPARATORS])
    at = F.position(F.col("__sep"), line)
    rest = _strip(F.substring(line, at + F.length("__sep"), F.length(line)))
    split = lines.withColumn("__sep", separator)
    has_sep = F.col("__sep").isNotNull()
    return split.select(
        *keys,
        "ordinal",
        F.when(has_sep, _strip(F.left(line, at - 1))).otherwise(line).alias("name"),
        F.when(has_sep, F.substring_index(rest, ",", 1)).otherwise("").alias("version"),
        F.lit("PyPI").alias("ecosystem"),
    )


def _last_of_each(entries: Column) -> Column:
    """One entry for each key: in the place of its first, with the value of its last."""
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1))
    return F.when(F.size(names) < F.size(entries), last).otherwise(entries)


def flag_empty_dependencies(requests: DataFrame, dependencies: str = "dependencies") -> DataFrame:
    """Add ``reason`` for requests whose list of dependencies is missing or empty."""
    some = F.coalesce(F.size(F.col(dependencies)), F.lit(0)) > 0
    return requests.withColumn("reason", F.when(~some, "Provide at least one dependency"))


def parse_package_json(manifests: DataFrame, content: str = "content") -> DataFrame:
    """package.json texts to one row per name of each of the three sections, in order.

    A name that is repeated within a section keeps its first place and its last version, as JSON readers have it.
    """
    keys = [c for c in manifests.columns if c != content]
    schema = ", ".join(f"{s} MAP<STRING, STRING>" for s in SECTIONS)
    parsed = F.from_json(F.col(content), schema)

    def entries(position: int, section: str) -> Column:
        listed = _last_of_each(F.coalesce(F.map_entries(F.col("__m")[section]),
                                          F.array().cast("array<struct<key:string,value:string>>")))
        return F.transform(listed, lambda e: F.struct(
            F.lit(position).alias("section_no"), F.lit(section).alias("section"),
            e["key"].alias("name"), e["value"].alias("raw")))

    return (
        manifests.select(*keys, parsed.alias("__m"))
        .select(*keys, F.posexplode(F.concat(*[entries(i, s) for i, s in enumerate(SECTIONS)])).alias("ordinal", "e"))
        .select(
            *keys, "ordinal", F.col("e.section").alias("section"), F.col("e.name").alias("name"),
            F.regexp_replace("e.raw", r"^[\^~>=<]+", "").alias("version"),
            F.lit("npm").alias("ecosystem"),
        )
    )
