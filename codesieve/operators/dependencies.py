"""Dependencies against an advisory table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.advisory import cve_id_pick, reference_urls, summary_or_default
from ..functions.severity import advisory_severity, risk_score, risk_score_of
from ..functions.versions import normal_name, version_key
from ..session import written
from .skew import HOT_ROWS, hot_keys, spread_join

_NAME = ["eco_key", "name_key"]
_PACKAGE = [*_NAME, "version"]
# Intervals, listed versions and entries of a name up to which a dependency is compared with each of them.
FEW = 64
_ABOVE_ALL = "\uffff"  # above all version keys


def with_ecosystem(deps: DataFrame, default: str = "PyPI") -> DataFrame:
    """Each package's own ecosystem, else that of the request."""
    return deps.withColumns({
        "ecosystem": F.coalesce(F.nullif("ecosystem", F.lit("")), F.lit(default)),
        "version": F.coalesce("version", F.lit("")),
    })


def _keyed(deps: DataFrame) -> DataFrame:
    return deps.withColumns({
        "eco_key": F.lower("ecosystem"),
        "name_key": normal_name(F.col("ecosystem"), F.col("name")),
    })


def advisory_packages(advisories: DataFrame) -> DataFrame:
    """One row per (advisory, package), each advisory naming a package once."""
    a = advisories.select(
        "id", F.col("affected"), F.struct(
            cve_id_pick(F.col("aliases"), F.col("id")).alias("cve_id"),
            summary_or_default(F.col("summary")).alias("summary"),
            advisory_severity(F.struct(*[F.col(c) for c in ("severity", "database_specific", "affected")])).alias("severity"),
            F.col("published"),
            reference_urls(F.col("references"), 5).alias("references"),
        ).alias("vuln"),
    )

    def keys(entry: Column) -> Column:
        eco = F.lower(entry["package"]["ecosystem"])
        return F.struct(eco.alias("eco_key"), normal_name(eco, entry["package"]["name"]).alias("name_key"))

    named = a.select("id", "vuln", "affected", F.explode(F.array_distinct(F.transform("affected", keys))).alias("p"))
    entries = F.filter("affected", lambda e: keys(e) == F.col("p"))
    mine = named.where("p.eco_key is not null and p.name_key is not null").select(
        "id", "vuln", "p.*", entries.alias("entries"))
    versions = F.flatten(F.filter(F.transform("entries", lambda e: e["versions"]), lambda v: v.isNotNull()))
    ranges = F.flatten(F.filter(F.transform("entries", lambda e: e["ranges"]), lambda r: r.isNotNull()))
    return mine.select("id", "vuln", "eco_key", "name_key", F.array_distinct(versions).alias("versions"), ranges.alias("ranges"))


def advisory_entries(advisories: DataFrame) -> DataFrame:
    """:func:`advisory_packages` as a table, each row with a number of its own, ``entry``."""
    return written(advisory_packages(advisories).withColumn("entry", F.monotonically_increasing_id()), "advisories")


def _intervals(events: Column, ecosystem: Column) -> Column:
    """The half-open intervals of version keys, ``low`` and ``high``, that the events of one range cover."""
    def keys(kind: str, behind: str = "") -> Column:
        def key(event: Column) -> Column:
            made = F.when(event[kind] == "0", F.lit("")).otherwise(version_key(event[kind], ecosystem))
            return F.concat(made, F.lit(behind)) if behind else made
        # Most events have one kind only; keys are made for that.
        some = F.filter(events, lambda e: e[kind].isNotNull())
        return F.filter(F.transform(some, key), lambda k: k.isNotNull())

    def opened(r: Column) -> Column:
        def interval(low: Column) -> Column:
            after = F.concat(F.filter(r["ends"], lambda e: e >= low), F.filter(r["opened"], lambda o: o > low))
            return F.struct(low.alias("low"), F.coalesce(F.array_min(after), F.lit(_ABOVE_ALL)).alias("high"))
        return F.filter(F.transform(r["opened"], interval), lambda i: i["low"] < i["high"])

    # The lambda around it binds the keys, so that each is made once.
    bound = F.struct(F.array_distinct(keys("introduced")).alias("opened"), F.concat(keys("fixed"), keys("last_affected", "\0")).alias("ends"))
    return F.element_at(F.transform(F.array(bound), opened), 1)


def _with_spans(entries: DataFrame) -> DataFrame:
    """Entries with their intervals as an array, ``spans``; made in the row of the entry, so nothing is shuffled."""
    ranges = F.filter("ranges", lambda r: F.coalesce(r["type"], F.lit("")) != "GIT")
    spans = F.flatten(F.filter(F.transform(ranges, lambda r: _intervals(r["events"], F.col("eco_key"))), lambda i: i.isNotNull()))
    return entries.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<low:string,high:string>>")))


def version_intervals(entries: DataFrame) -> DataFrame:
    """(eco_key, name_key, entry, low, high): the half-open intervals of version keys that the ranges cover.

    An introduced version opens an interval; the next event at or after it ends it: a fix before itself, a last
    affected version behind itself.  "0" lies below all versions.  Ranges that nothing opens cover nothing.
    """
    return _with_spans(entries).select(*_NAME, "entry", F.explode("spans").alias("i")).select(*_NAME, "entry", "i.low", "i.high")


def _packages(keyed: DataFrame, entries: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct packages whose names have advisories (``known``), with the number of rows that name them; also those of
    more than ``hot_rows`` rows."""
    named = keyed.where(F.col("eco_key").isNotNull() & F.col("name_key").isNotNull())
    counted = named.groupBy(*_PACKAGE).agg(F.count("*").alias("uses"))
    known = entries.select("eco_key", "name_key").distinct().withColumn("known", F.lit(True))
    found = counted.join(known, ["eco_key", "name_key"], "left").where((F.col("uses") > hot_rows) | F.col("known"))
    return written(found.select(*_PACKAGE, "uses", "known"), "packages")


def _with_keys(versions: DataFrame) -> DataFrame:
    """Packages with the keys of their versions; few versions are shared by many names, so each is parsed once."""
    keys = versions.select("eco_key", "version").distinct().withColumn("key", version_key(F.col("version"), F.col("eco_key")))
    return versions.join(keys.where("key is not null"), ["eco_key", "version"])


def _covering(low: Column, high: Column, levels: int) -> Column:
    """The fewest aligned blocks of 2^level places that together are the places [low, high)."""
    def at(level: Column) -> Column:
        first = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        stop = F.call_function("shiftright", high, level)
        some = first < stop
        return F.array(F.when(some & (first % 2 == 1), F.struct(level.alias("level"), first.alias("block"))),
                       F.when(some & (stop % 2 == 1), F.struct(level.alias("level"), (stop - 1).alias("block"))))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))
    return F.filter(every, lambda b: b.isNotNull())


def _disjoint(intervals: DataFrame) -> DataFrame:
    """The intervals of each entry with those that meet put together."""
    earlier = Window.partitionBy("entry").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("entry").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("low") > F.max("high").over(earlier), F.lit(True))
    return (intervals.withColumn("opens", opens).withColumn("no", F.count_if("opens").over(so_far))
            .groupBy(*_NAME, "entry", "no").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("no"))


def _range_matches(packages: DataFrame, entries: DataFrame, of_package: Sequence[str] = (), of_entry: Sequence[str] = ()) -> DataFrame:
    """(package, entry), each once, for versions within an interval of an entry, by an interval index.

    Versions and the ends of intervals are sorted together, over all names, by ranges, so that a name with most
    of the versions is many tasks' work.  The places of an interval are cut into aligned blocks of
    powers of two, at most two of a size; a version lies in one block of each size.  Joined by block, a version meets
    an entry only where the entry covers it, whatever else is known of the name.  That join comes last and moves only what goes in.
    """
    intervals = written(_disjoint(version_intervals(entries)), "intervals")
    none = F.lit(None)
    known = packages.where("known and version != ''")
    ends = intervals.select("eco_key", "name_key", F.explode(F.array("low", "high")).alias("key"))
    # Ends come before versions of the same key: the first place of an interval is that of the first version in it.
    points = ends.distinct().select("eco_key", "name_key", "key", F.lit(0).alias("kind"), none.cast("string").alias("version"),
                                     *[none.cast(known.schema[c].dataType).alias(c) for c in of_package]) \
        .unionByName(_with_keys(known).select("eco_key", "name_key", "key", F.lit(1).alias("kind"), "version", *of_package))
    order = ["eco_key", "name_key", "key", "kind", "version"]
    places = written(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "version-places")

    # Spark numbers rows as (partition, row) with 33 bits for the row; drop the bits that no row uses.
    row = F.col("place").bitwiseAND((1 << 33) - 1)
    most = places.agg(F.max(row).alias("row"), F.max(F.call_function("shiftright", "place", F.lit(33))).alias("part")).first()
    bits = max(1, int(most.row or 0).bit_length())
    levels = bits + int(most.part or 0).bit_length()
    places = places.withColumn("place", F.call_function("shiftleft", F.call_function("shiftright", "place", F.lit(33)), F.lit(bits)) + row)

    at = places.where("kind = 0").select("eco_key", "name_key", "key", "place")
    low = at.select("eco_key", "name_key", F.col("key").alias("low"), F.col("place").alias("first"))
    high = at.select("eco_key", "name_key", F.col("key").alias("high"), F.col("place").alias("stop"))
    blocks = (intervals.join(low, ["eco_key", "name_key", "low"])
              .join(high, ["eco_key", "name_key", "high"])
              .select("eco_key", "name_key", "entry", F.explode(_covering(F.col("first"), F.col("stop"), levels)).alias("b"))
              .select("eco_key", "name_key", "entry", "b.level", "b.block"))
    used = blocks.groupBy("eco_key", "name_key").agg(F.collect_set("level").alias("levels"))  # at most 64 of a name
    of_versions = (places.where("kind = 1").join(used, ["eco_key", "name_key"])
                   .select(*_PACKAGE, *of_package, "place", F.explode("levels").alias("level"))
                   .select(*_PACKAGE, *of_package, "level", F.call_function("shiftright", "place", F.col("level")).alias("block")))
    if of_entry:
        blocks = blocks.join(entries.select("entry", *of_entry), "entry")
    return of_versions.join(blocks.select("entry", *of_entry, "level", "block"), ["level", "block"]).select(*_PACKAGE, *of_package, "entry", *of_entry)


def _within(spans: Column, key: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: (s["low"] <= key) & (key < s["high"])), F.lit(False))


def package_matches(packages: DataFrame, entries: DataFrame, of_package: Sequence[str] = (), of_entry: Sequence[str] = ()) -> DataFrame:
    """(package, entry), each once: the entries of :func:`advisory_entries` for each distinct (ecosystem, name, version).
    Further columns of either side may come along.

    Dependencies are reduced to distinct packages first, on the map side, so a
    package that a third of all manifests name is matched once.  A version is affected if an entry lists
    it or has it in a range; no version means any version.  Each way is a join by equality whose rows are matches.
    """
    listing = _with_spans(entries.where(F.size("versions") > 0)).select(*_NAME, "entry", *of_entry, "spans", F.explode("versions").alias("version"))
    listed = packages.where("version != ''").join(listing, _PACKAGE).where(~_within(F.col("spans"), version_key(F.col("version"), F.col("eco_key"))))
    any_version = packages.where("version = ''").join(entries.select(*_NAME, "entry", *of_entry), _NAME)
    ways = [listed, any_version, _range_matches(packages, entries, of_package, of_entry)]
    pairs = [w.select(*_PACKAGE, *of_package, "entry", *of_entry) for w in ways]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2])


def package_findings(deps: DataFrame, advisories: DataFrame, default_ecosystem: str = "PyPI") -> DataFrame:
    """Every distinct package with each of its vulnerabilities, and ``uses``, the number of dependencies that name it.

    These are the rows of :func:`dependency_findings` that have a vulnerability, counted and not written out.
    """
    entries = advisory_entries(advisories)
    packages = _packages(_keyed(with_ecosystem(deps, default_ecosystem)), entries)
    found = package_matches(packages.where("known"), entries, ["uses"], ["id"])
    return found.select(*_PACKAGE, F.col("id").alias("advisory_id"), "uses")


def _by_length(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with ``spans``, and the names that have more than :data:`FEW` of them, their intervals and listed versions."""
    sized = written(_with_spans(entries), "spans")
    weight = F.sum(1 + F.size("versions") + F.size("spans"))
    return sized, written(sized.groupBy(*_NAME).agg(weight.alias("weight")).where(F.col("weight") > FEW).select(*_NAME), "long-names")


def _with_entries(keyed: DataFrame, sized: DataFrame, about: Column) -> DataFrame:
    """Dependencies with ``found``, an array of what is said ``about`` the entries that affect them; for names with few entries.

    The entries of a name are one row, which its dependencies meet in one join; each is compared in the row.
    """
    names = sized.groupBy(*_NAME).agg(F.collect_list(F.struct("versions", "spans", about.alias("about"))).alias("entries"))

    def affects(e: Column, key: Column) -> Column:
        return (F.col("version") == "") | F.array_contains(e["versions"], F.col("version")) | _within(e["spans"], key)

    known = F.col("entries").isNotNull()
    key = F.when(known & (F.col("version") != ""), version_key(F.col("version"), F.col("eco_key")))
    # The lambda around it binds the key, so that it is made once for a row and not for every interval.
    matched = F.element_at(F.transform(F.array(key), lambda k: F.filter("entries", lambda e: affects(e, k))), 1)
    found = F.when(known, F.transform(matched, lambda e: e["about"]))
    return keyed.join(names, _NAME, "left").withColumn("found", found).drop("entries")


def _back_to_dependencies(keyed: DataFrame, packages: DataFrame, found: DataFrame, hot_rows: int) -> DataFrame:
    hot = hot_keys(packages, _PACKAGE, "uses", hot_rows)
    return spread_join(keyed, found, on=_PACKAGE, spread_by=["scan_id", "ordinal"], hot=hot)


def dependency_findings(deps: DataFrame, advisories: DataFrame, default_ecosystem: str = "PyPI",
                        hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every dependency with each of its vulnerabilities, or with nulls if none."""
    keyed = _keyed(with_ecosystem(deps, default_ecosystem))
    entries = advisory_entries(advisories)
    sized, long_names = _by_length(entries)
    about = F.struct("id", "vuln")
    row = ["scan_id", "ordinal", "name", "version", "ecosystem"]
    if long_names.isEmpty():
        joined = _with_entries(keyed, sized, about).select(*row, F.explode_outer("found").alias("a"))
    else:
        short = _with_entries(keyed.join(long_names, _NAME, "left_anti"), sized.join(long_names, _NAME, "left_anti"), about)
        keyed, entries = keyed.join(long_names, _NAME, "left_semi"), entries.join(long_names, _NAME, "left_semi")
        packages = _packages(keyed, entries, hot_rows)
        long = _back_to_dependencies(keyed, packages, package_matches(packages, entries), hot_rows)
        # What advisories say is joined last, so that no other step moves their texts.
        long = long.join(entries.select("entry", F.when(F.lit(True), about).alias("a")), "entry", "left")
        joined = short.select(*row, F.explode_outer("found").alias("a")).unionByName(long.select(*row, "a"))
    return joined.select(
        *row, F.col("a.id").alias("advisory_id"), *[F.col(f"a.vuln.{c}").alias(c) for c in ("cve_id", "summary", "severity", "published", "references")])


def dependency_risk(deps: DataFrame, advisories: DataFrame, default_ecosystem: str = "PyPI",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every dependency with its number of vulnerabilities and risk score.

    Packages that no advisory knows, or whose lookup found nothing, have none.
    """
    keyed = _keyed(with_ecosystem(deps, default_ecosystem))
    entries = advisory_entries(advisories)
    sized, long_names = _by_length(entries)
    row = ["scan_id", "ordinal", "name", "version", "ecosystem"]

    def rated(df: DataFrame) -> DataFrame:
        found = F.coalesce("found", F.array().cast("array<string>"))
        return df.select(*row, F.size(found).cast("long").alias("n_vulns"), risk_score_of(found).alias("risk_score"))

    if long_names.isEmpty():
        return rated(_with_entries(keyed, sized, F.col("vuln.severity")))
    short = rated(_with_entries(keyed.join(long_names, _NAME, "left_anti"), sized.join(long_names, _NAME, "left_anti"), F.col("vuln.severity")))
    keyed, entries = keyed.join(long_names, _NAME, "left_semi"), entries.join(long_names, _NAME, "left_semi")
    packages = _packages(keyed, entries, hot_rows)
    matched = package_matches(packages, entries.withColumn("severity", F.col("vuln.severity")), of_entry=["severity"])
    scored = matched.groupBy(*_PACKAGE).agg(F.count("*").alias("n_vulns"), risk_score(F.col("severity")).alias("risk_score"))
    long = _back_to_dependencies(keyed, packages, scored, hot_rows)
    return short.unionByName(long.select(
        *row,
        F.coalesce("n_vulns", F.lit(0)).alias("n_vulns"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
    ))


def risk_of_findings(found: DataFrame) -> DataFrame:
    """``dependency_risk`` from the rows of ``dependency_findings``.

    Manifests of a scan may name the same package at the same place.  Each of these equal rows has every advisory once, so the
    number of rows for one advisory tells how many they are, and each comes out as a row of its own.
    """
    key = ["scan_id", "ordinal", "name", "version", "ecosystem"]
    once = found.groupBy(*key, "advisory_id").agg(F.count("*").alias("rows"), F.first("severity").alias("severity"))
    scored = once.groupBy(*key).agg(
        F.count("advisory_id").alias("n_vulns"), risk_score(F.col("severity")).alias("risk_score"), F.max("rows").alias("rows"))
    return scored.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("rows", "row")


def vulnerable_only(risk: DataFrame) -> DataFrame:
    return risk.where(F.col("n_vulns") > 0)


def dependency_summary(risk: DataFrame) -> DataFrame:
    """Packages and vulnerable packages per scan."""
    return risk.groupBy("scan_id").agg(
        F.count("*").alias("total_packages"),
        F.count_if(F.col("n_vulns") > 0).alias("vulnerable_packages"),
    )
