"""Scans with rule tables of any size.

The built-in rules are literals of the plan, which suits dozens.  Here rules stay rows: every rule has literals that
its matches must contain, each literal stands in an index under one of its trigrams, and texts meet rules by joining their trigrams
with that index.  Only candidates that hold the whole literal run their pattern, which is a column.  Rules of equal patterns run it once.

Rules whose matches start with their literal, at the start of a word, and stay within the word meet words by their first three letters:
the words of a file go to the rules of their letters, and different words (with their neighbouring characters) run them once.  What a rule finds in a
line comes from words of the same letters, so that words are moved once and neither their hits nor the findings are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules.anchors import anchors, problem, within_word, word_start
from ..rules.model import TextRule
from ..session import dealt, written
from .matching import _HIT, _VALUE_END, _without_markers, hit_count, hit_values, java_pattern
from .secrets import shannon_entropy

KINDS = ("code", "owasp", "secrets")
_PREPARED = "rule_id string, java string, literals array<string>, by_word boolean, problem string"
# What rules have in common that can be run as one.
_PATTERN = ("java", "literals", "by_word", "value_group", "secret", "min_entropy")
_TWINS = ("İıſK", "iisk")  # letters that match an ASCII one without case


def prepared_rules(table: DataFrame) -> DataFrame:
    """A rule table with each pattern as Java reads it and its literals.

    ``table`` has rule_id and pattern, and may have kind (code, owasp or secrets; default code), severity, title, languages,
    ignore_case, value_group and min_entropy.  Patterns that do not compile or that match the empty text are refused
    with their rules' ids.  Ids are taken to be unique.
    """
    def read_pattern(pattern: str, ignore_case: bool) -> tuple:
        wrong = problem(pattern)
        if wrong:
            return None, [], False, wrong
        return java_pattern(TextRule("", pattern, ignore_case=ignore_case)), anchors(pattern), word_start(pattern) is not None and within_word(pattern), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lru_cache(10_000)(read_pattern)
        for batch in batches:
            out = [(rule_id, *read(pattern, ignore_case))
                   for rule_id, pattern, ignore_case in zip(*(batch.column(c).to_pylist() for c in ("rule_id", "pattern", "ignore_case")))]
            ids, java, literals, by_word, wrong = zip(*out) if out else ((), (), (), (), ())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(java, pa.string()), pa.array(literals, pa.list_(pa.string())),
                                   pa.array(by_word, pa.bool_()), pa.array(wrong, pa.string())], names=["rule_id", "java", "literals", "by_word", "problem"])

    have = set(table.columns)

    def column(name: str, default, kind: str) -> Column:
        value = F.lit(default).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), value) if name in have else value).alias(name)

    full = table.select("rule_id", "pattern", column("kind", "code", "string"), column("severity", "medium", "string"), column("title", "", "string"),
                        (F.transform("languages", F.lower) if "languages" in have else F.lit(None).cast("array<string>")).alias("languages"),
                        column("ignore_case", True, "boolean"), column("value_group", 0, "int"), column("min_entropy", 0.0, "double"))
    full = written(full, "rule-table")
    read = dealt(full.select("rule_id", "pattern", "ignore_case"), "rule_id").sortWithinPartitions("pattern").mapInArrow(run, _PREPARED)
    rules = written(full.join(read, "rule_id"), "rules")
    wrong = rules.where("problem is not null").first()
    if wrong:
        raise ValueError(f"rule {wrong.rule_id}: {wrong.problem}")
    return rules.drop("problem", "pattern")


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def _folded(text: Column) -> Column:
    """Lower-cased so that every ASCII literal that matches without case is there as it is."""
    return F.lower(F.translate(text, *_TWINS))


def rule_postings(rules: DataFrame) -> DataFrame:
    """(trigram, literal, rule_id): each literal under that of its trigrams which fewest literals have.

    Rules without literals stand under the empty trigram, which every text is taken to have.
    """
    literals = rules.select("rule_id", F.explode("literals").alias("literal"))
    keys = literals.select("literal").distinct().select("literal", F.explode(_trigrams(F.col("literal"))).alias("trigram"))
    rare = keys.groupBy("trigram").agg(F.count("*").alias("n"))
    chosen = keys.join(rare, "trigram").groupBy("literal").agg(F.min_by("trigram", F.struct("n", "trigram")).alias("trigram"))
    none = rules.where(F.size("literals") == 0).select(F.lit("").alias("trigram"), F.lit("").alias("literal"), "rule_id")
    return literals.join(chosen, "literal").select("trigram", "literal", "rule_id").unionByName(none)


def candidates(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id): the rules whose trigram a text has; ``files`` are (key, folded)."""
    grams = files.select("key", F.explode(F.concat(_trigrams(F.col("folded")), F.array(F.lit("")))).alias("trigram"))
    return grams.join(rule_postings(rules).select("trigram", "rule_id").distinct(), "trigram").select("key", "rule_id").distinct()


def scan_with_table(files: DataFrame, table: DataFrame) -> DataFrame:
    """Findings of the rules of a table: (scan_id, file_path, kind, rule_id, severity, title, line_number, n_hits).

    One row per file, rule and line.  ``n_hits`` is 1 for code rules, the number of matches for OWASP rules, and for secrets the number of
    different values (of the rule's group) that have its least entropy.  The rows are those that the same rules
    give as literals of the plan.  A text (for rules of words: its words) is moved once, to meet its candidates; nothing but the findings grows with files x rules.
    Files with equal columns and text each have their findings.  Null texts have none.
    """
    secret = F.col("kind") == "secrets"
    # A secret without a group has the rest of its line as value, which no word holds.
    by_word = F.col("by_word") & (~secret | (F.col("value_group") > 0))
    rules = prepared_rules(table).withColumns({"secret": secret, "by_word": by_word, "min_entropy": F.when(secret, F.col("min_entropy")).otherwise(0.0)})
    # Of rules with one pattern the first stands for all.
    member = F.struct(F.col("rule_id").alias("member_id"), "kind", "severity", "title", "languages")
    patterns = rules.groupBy(*_PATTERN).agg(F.min("rule_id").alias("rule_id"), F.collect_list(member).alias("members")).withColumn(
        "replacement", F.when(F.col("value_group") > 0, F.concat(F.lit(_HIT + "$"), F.col("value_group").cast("string"), F.lit(_VALUE_END + "$0")))
        .otherwise(_HIT + "$0"))
    patterns = written(patterns, "patterns")
    source = files.select("scan_id", "file_path", "code", F.lower(F.coalesce("language", F.lit("python"))).alias("language")) \
        .where("code is not null and code != ''").withColumn("key", F.xxhash64("scan_id", "file_path", "language", "code"))
    parts = {by_word: patterns.where(F.col("by_word") == by_word) for by_word in (True, False)}
    found = [find(source, part) for find, part in ((_in_words, parts[True]), (_in_texts, parts[False])) if not part.isEmpty()]
    if not found:
        found = [_in_texts(source, parts[False])]
    found = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    language = F.col("languages").isNull() | (F.size("languages") == 0) | F.array_contains("languages", "any") | F.array_contains("languages", F.col("language"))
    return found.select("*", "member.*").where(language).select(
        "scan_id", "file_path", "kind", F.col("member_id").alias("rule_id"), "severity", "title", "line_number", F.when(F.col("kind") == "code", 1).otherwise(F.col("n")).alias("n_hits"))


_RUN = ("rule_id", "java", "replacement", "secret", "min_entropy")
_FILE = ("scan_id", "file_path", "language")
# Words of one part of the files that meet the rules of their letters in one task: about a sixth of so many characters.
PART_CHARS = 150_000_000


def _marked(text: Column, rule=F.col) -> Column:
    """``rule`` gives a field of the rule."""
    return F.regexp_replace(_without_markers(text), rule("java"), rule("replacement"))


def _values(marked: Column, rule=F.col) -> Column:
    """The different values in a marked text that have the least entropy."""
    return F.filter(F.array_distinct(hit_values(marked)), lambda v: (rule("min_entropy") == 0) | (shannon_entropy(v) >= rule("min_entropy")))


def _in_texts(source: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lines with their rules and numbers of hits or values, from whole texts."""
    wanted = candidates(source.select("key", _folded(F.col("code")).alias("folded")), patterns)
    # The patterns of a text come as rows of their own; sizes decide whether a join is broadcast.
    met = source.join(wanted, "key").join(patterns.select(*_RUN, "literals"), "rule_id")
    holds = (F.size("literals") == 0) | F.exists("literals", lambda x: F.contains(_folded(F.col("code")), x))
    kept = [*_FILE, "rule_id", "secret", "min_entropy"]
    marked = met.select(*kept, F.when(holds, _marked(F.col("code"))).alias("marked")).where(F.contains("marked", F.lit(_HIT)))
    lines = marked.select(*kept, F.posexplode(F.split("marked", "\n", -1)).alias("at", "line")).where(F.contains("line", F.lit(_HIT)))
    n = F.when(F.col("secret"), F.size(_values(F.col("line")))).otherwise(hit_count(F.col("line")))
    return lines.select(*_FILE, "rule_id", (F.col("at") + 1).alias("line_number"), n.alias("n")).where("n > 0") \
        .join(patterns.select("rule_id", F.explode("members").alias("member")), "rule_id").select(*_FILE, "member", "line_number", "n")


def _word_rows(source: DataFrame) -> DataFrame:
    """(file, _FILE, head, words): the words of a file that start with the same three letters, as one text.

    A word is given with the character before and after it and stands before its line's place, with marks between.
    """
    lines = F.split(_without_markers(F.col("code")), "\n", -1)

    def words(line: Column, at: Column) -> Column:
        text = F.concat(F.when(at > 0, "\n").otherwise(""), line, F.when(at < F.size("lines") - 1, "\n").otherwise(""))
        # Between words their first and last character stay, one on each side of the cut.
        cut = F.split(F.regexp_replace(text, r"(?sU)(\W)\W*(?<=(\W))", f"$1{_HIT}$2"), _HIT, -1)
        head = lambda word: F.regexp_extract(_folded(word), r"(?sU)\b(\w\w\w)", 1)
        entries = F.transform(F.filter(cut, lambda word: F.length(word) >= 3), lambda word: F.concat(head(word), F.lit(_VALUE_END), word, F.lit(_VALUE_END), at.cast("string")))
        return F.filter(entries, lambda entry: ~F.startswith(entry, F.lit(_VALUE_END)))

    # Sorted, words with the same letters stand in a row.
    joined = F.array_join(F.sort_array(F.flatten(F.transform("lines", words))), _HIT)
    rows = F.regexp_extract_all(joined, F.lit(rf"([^{_VALUE_END}{_HIT}]+){_VALUE_END}[^{_HIT}]*+(?:{_HIT}\1{_VALUE_END}[^{_HIT}]*+)*+"), F.lit(0))
    # Equal files are told apart by their numbers.
    mark, head = F.lit(_VALUE_END), F.substring_index("row", _VALUE_END, 1)
    return source.select(F.monotonically_increasing_id().alias("file"), *_FILE, lines.alias("lines")).select("file", *_FILE, F.explode(rows).alias("row")) \
        .select("file", *_FILE, head.alias("head"), "row") \
        .select("file", *_FILE, "head", F.substr(F.replace("row", F.concat(F.lit(_HIT), "head", mark), F.lit(_HIT)), F.length("head") + 2).alias("words"))


def _in_words(source: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same for rules of words.

    Words are dealt once, by their letters and the part of the files that theirs is in; all else is done where they are.
    """
    chars = source.agg(F.sum(F.length("code"))).first()[0] or 0
    parts = -(-chars // PART_CHARS) or 1
    rule = F.struct("java", "replacement", "secret", "min_entropy", F.col("literals")[0].alias("literal"), "members")
    heads = written(patterns.groupBy(F.substring(F.col("literals")[0], 1, 3).alias("head")).agg(F.collect_list(rule).alias("rules")), "rule-heads")
    # The rules of the letters, for each part; a rule is known by its place.
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    runs = heads.select("head", "part", F.transform("rules", lambda r: F.struct(*(r[c].alias(c) for c in ("java", "replacement", "secret", "min_entropy", "literal")))).alias("rules"))
    dealt_words = _word_rows(source).withColumn("part", F.pmod(F.xxhash64(*_FILE), F.lit(parts))).repartition("head", "part")
    entry = F.split("entry", _VALUE_END, -1)
    occurring = dealt_words.select("file", *_FILE, "head", "part", F.explode(F.split("words", _HIT, -1)).alias("entry")) \
        .select("file", *_FILE, "head", "part", entry[0].alias("word"), entry[1].cast("int").alias("at"))
    # The first of equal words runs the rules, the others take what it has found.
    before = F.lag("word").over(Window.partitionBy("head", "part").orderBy("word"))
    word, unit = F.col("word"), ["head", "part", "file", *_FILE, "at"]

    def run(r: Column, i: Column) -> Column:
        marked = F.when((F.length(r["literal"]) == 3) | F.contains(_folded(word), r["literal"]), _marked(word, r.getField))
        return F.struct(i.alias("rule"), r["secret"].alias("secret"), r["min_entropy"].alias("min_entropy"), marked.alias("marked"))

    def found(m: Column) -> Column:
        values = F.when(m["secret"], _values(m["marked"], m.getField)).otherwise(F.array(F.lit(None).cast("string")))
        return F.struct(m["rule"].alias("rule"), m["secret"].alias("secret"), F.when(m["secret"], 1).otherwise(hit_count(m["marked"])).alias("hits"), values.alias("values"))

    hits = F.transform(F.filter(F.transform("rules", run), lambda m: F.contains(m["marked"], F.lit(_HIT))), found)
    first = occurring.withColumn("before", before).join(runs, ["head", "part"]) \
        .select(*unit, "word", F.when(F.col("before").isNull() | (F.col("before") != word), hits).alias("hits"))
    matched = first.withColumn("hits", F.first("hits", ignorenulls=True).over(Window.partitionBy("head", "part", "word"))) \
        .select(*unit, F.explode("hits").alias("hit")).select(*unit, "hit.rule", "hit.secret", "hit.hits", F.explode("hit.values").alias("value"))
    each = matched.groupBy(*unit, "rule", "secret", "value").agg(F.sum("hits").alias("hits"))
    counted = each.groupBy(*unit, "rule", "secret").agg(F.count("*").alias("values"), F.sum("hits").alias("hits"))
    members = heads.select("head", "part", F.transform("rules", lambda r: r["members"]).alias("members"))
    return counted.join(members, ["head", "part"]).select(
        *_FILE, F.explode(F.element_at("members", F.col("rule") + 1)).alias("member"), (F.col("at") + 1).alias("line_number"),
        F.when(F.col("secret"), F.col("values")).otherwise(F.col("hits")).cast("int").alias("n"))
