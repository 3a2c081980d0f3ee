"""Inputs of the registered queries, derived from the driver's tables.

The tables hold prose, orders and parts and no source code, manifests or
advisories.  Each function derives one such input from whole tables, row by row;
``SQL`` has the same derivation as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, spread
from .snippets import SNIPPETS

EXTENSIONS = (".py", ".js", ".c", ".java", ".go")
LANGUAGES = ("python", "javascript", "c", "java", "go")
SQL: dict[str, str] = {}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def with_inputs(*names: str, query: str) -> str:
    """A statement with the named derivations in front."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + query


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _choose(values, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _choose_sql(values, key: str) -> str:
    return f"{sql_list(values)}[(({key}) % {len(values)}) + 1]"


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


# --- source files: every document with one code snippet appended -------------

def file_columns(shift: Column | None = None) -> list[Column]:
    doc = F.col("doc_id")
    at = doc if shift is None else doc + shift
    return [
        F.concat(F.lit("scan-"), "source").alias("scan_id"),
        F.concat(F.lit("src/"), _text("doc_id"), _choose(EXTENSIONS, doc)).alias("file_path"),
        _choose(LANGUAGES, doc).alias("language"),
        F.concat("text", F.lit("\n"), _choose(SNIPPETS, at)).alias("code"),
    ]


def _files_sql(at: str) -> str:
    return f"""SELECT 'scan-' || source AS scan_id,
  'src/' || CAST(doc_id AS VARCHAR) || {_choose_sql(EXTENSIONS, 'doc_id')} AS file_path,
  {_choose_sql(LANGUAGES, 'doc_id')} AS language,
  text || chr(10) || {_choose_sql(SNIPPETS, at)} AS code
FROM documents"""


SQL["files"] = _files_sql("doc_id")
SQL["old_files"] = _files_sql("doc_id + (CASE WHEN lang = 'en' THEN 0 ELSE 1 END)")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id")
    return docs.select(*file_columns())


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the files: those not in English had another snippet."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), "doc_id")
    return docs.select(*file_columns(F.when(F.col("lang") == "en", 0).otherwise(1)))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan ids alone, so only one column is read."""
    return table(spark, sf_dir, "documents", "source").select(F.concat(F.lit("scan-"), "source").alias("scan_id"))


# --- submitted requests -----------------------------------------------------

SQL["submissions"] = """SELECT 'scan-' || source AS scan_id, doc_id,
  CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'app/' || CAST(doc_id AS VARCHAR) || '.py' END AS file_path,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Python' WHEN 2 THEN 'JavaScript' WHEN 3 THEN 'go' ELSE 'PHP' END AS language,
  CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS code,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['code'] WHEN 2 THEN ['owasp', 'secrets'] ELSE ['secrets', 'zap'] END AS scan_types
FROM documents"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    texts = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        F.concat(F.lit("scan-"), "source").alias("scan_id"), "doc_id",
        F.when(d % 3 == 1, "").when(d % 3 == 2, F.concat(F.lit("app/"), _text(d), F.lit(".py"))).alias("file_path"),
        F.when(d % 5 == 1, "Python").when(d % 5 == 2, "JavaScript").when(d % 5 == 3, "go")
        .when(d % 5 == 4, "PHP").alias("language"),
        F.when(d % 7 == 0, "").when(d % 7 == 1, F.lit(None)).otherwise(F.col("text")).alias("code"),
        F.when(d % 4 == 1, texts("code")).when(d % 4 == 2, texts("owasp", "secrets"))
        .when(d % 4 == 3, texts("secrets", "zap")).alias("scan_types"),
    )


# --- reports of external scanners, one per document --------------------------

def _concat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _concat_sql(*parts) -> str:
    return " || ".join(p[0] if isinstance(p, tuple) else quote(p) for p in parts)


# A report is a list of literal texts and of names in braces, filled per row.
_GITLEAKS = (
    ('[{"RuleID":"generic-api-key","Description":"Generic key","Secret":"', "{hash}", '","Match":"token = ', "{hash}",
     '","File":"/tmp/x', "{id}", '","StartLine":', "{line}", ',"Fingerprint":"fp-', "{id}",
     '"},{"RuleID":"short","Secret":"abc","Match":"0123456789abcdefXYZ","File":"/tmp/y","StartLine":3}]'),
    ('{"RuleID":"jwt","Secret":"ey', "{id}", '","Match":"ey', "{hash}", '","File":"/tmp/z","StartLine":', "{line}", '}'),
    ("[]",),
    ('not json [', "{id}"),
    ('[{"Match":"m', "{id}", '"}]'),
)
_TRUFFLEHOG = (
    ('{"Raw":"', "{hash}", '","DetectorName":"AWS","Verified":true,"StructuredData":{"id":"sd', "{id}",
     '"},"SourceMetadata":{"Data":{"Filesystem":{"file":"/tmp/a', "{id}", '","line":', "{line}", '}}}}\n'
     '\n{broken\n{"RawV2":"', "{hash}", '","SourceMetadata":{"Data":{"Git":{"file":"g.py","lineNumber":7}}}}'),
    ('{"Raw":"","DetectorName":"Slack","Verified":false,"SourceMetadata":{"Data":{"Filesystem":{"file":"","line":0},'
     '"Git":{"file":"b', "{id}", '.py","lineNumber":0}}}}\n'),
    ("",),
    ('{"Raw":"abc","DetectorName":"Tiny"}\n   \n{"DetectorName":"NoRaw","Verified":true}'),
)
_BEARER = (
    ('{"critical":[{"id":"r', "{id}", '","title":"T","description":"D","category":"C","filename":"/tmp/s.py",'
     '"line_number":', "{line}", ',"code_extract":"x = 1","documentation_url":"https://example.com/', "{id}",
     '","cwe_ids":["89","20"],"owasp":{"name":"A03"}}],"warning":[{"rule_id":"w1","source":{"start":', "{line}", '}}]}'),
    ('{"odd":[{"id":"o', "{id}", '","line_number":0,"owasp":"text"}],"high":"not a list"}'),
    ("[1, 2]",),
    ('{"HIGH":[{},{"rule_id":"h', "{id}", '","cwe_ids":[]}],"low":[]}'),
    ("{broken",),
)


def _shape(parts) -> tuple:
    return parts if isinstance(parts, tuple) else (parts,)


def _reports(spark: SparkSession, sf_dir: str, shapes) -> DataFrame:
    d = F.col("doc_id")
    fill = {"{id}": _text(d), "{hash}": F.sha1(_text(d)), "{line}": _text(d % 9)}
    texts = [_concat(*[fill.get(p, p) for p in _shape(s)]) for s in shapes]
    report = F.element_at(F.array(*texts), (d % len(shapes) + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id").select(
        F.concat(F.lit("scan-"), "source").alias("scan_id"),
        F.concat(F.lit("src/"), _text(d), _choose(EXTENSIONS, d)).alias("file_path"), report.alias("report"))


def _reports_sql(shapes) -> str:
    fill = {"{id}": ("CAST(doc_id AS VARCHAR)",), "{hash}": ("sha1(CAST(doc_id AS VARCHAR))",),
            "{line}": ("CAST(doc_id % 9 AS VARCHAR)",)}
    cases = " ".join(
        f"WHEN {i} THEN " + _concat_sql(*[fill.get(p, p) for p in _shape(s)]) for i, s in enumerate(shapes))
    return f"""SELECT 'scan-' || source AS scan_id, doc_id % {len(shapes)} AS shape,
  'src/' || CAST(doc_id AS VARCHAR) || {_choose_sql(EXTENSIONS, 'doc_id')} AS file_path,
  CASE doc_id % {len(shapes)} {cases} END AS report FROM documents"""


SQL["gitleaks"], SQL["trufflehog"], SQL["bearer"] = map(_reports_sql, (_GITLEAKS, _TRUFFLEHOG, _BEARER))


def gitleaks(spark, sf_dir):
    return _reports(spark, sf_dir, _GITLEAKS)


def trufflehog(spark, sf_dir):
    return _reports(spark, sf_dir, _TRUFFLEHOG)


def bearer(spark, sf_dir):
    return _reports(spark, sf_dir, _BEARER)


# --- user rules, one per word of the part names: words that begin like it -------------

SQL["user_rules"] = """SELECT 'word-' || w AS rule_id, left(w, 2) AS head, CASE WHEN length(w) > 4 THEN 'high' ELSE 'low' END AS severity,
  'Like ' || w AS title, CASE WHEN length(w) = 4 THEN 'python' ELSE 'any' END AS rule_language
FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"""


def user_rules(spark, sf_dir):
    word, head = F.col("w"), F.left("w", F.lit(2))
    words = table(spark, sf_dir, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.select(
        word.alias("rule_order"), _concat("word-", word).alias("rule_id"), _concat(r"(^|[ (])", head).alias("pattern"),
        F.when(F.length(word) > 4, "high").otherwise("low").alias("severity"), _concat("Like ", word).alias("title"),
        F.array(F.when(F.length(word) == 4, "Python").otherwise("any")).alias("languages"), F.array(head).alias("required_literals"))


# --- one rule per part: words that begin with three letters, and what follows --------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTER_SQL = "substr('" + _LETTERS + "', CAST({} AS INT) % 26 + 1, 1)"
SQL["rule_table"] = ("SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS rule_id, " + " || ".join(_LETTER_SQL.format(f"(p_partkey * 7919 // {d})") for d in (1, 26, 676))
                     + " AS head, ['code', 'owasp', 'secrets'][p_partkey % 3 + 1] AS kind, p_partkey % 5 = 0 AS python_only FROM part")


def rule_table(spark, sf_dir):
    p = F.col("p_partkey")
    head = F.concat(*[F.substring(F.lit(_LETTERS), (F.floor(p * 7919 / d) % 26 + 1).cast("int"), F.lit(1)) for d in (1, 26, 676)])
    kind = _choose(("code", "owasp", "secrets"), p)
    return table(spark, sf_dir, "part", "p_partkey").select(
        _concat("part-", _text(p)).alias("rule_id"), kind.alias("kind"),
        F.when(kind == "secrets", _concat(r"\b(", head, r"[a-z]{3,})(?=\W|_|\d|$)")).otherwise(_concat(r"\b", head, r"\w*")).alias("pattern"),
        F.array(F.when(p % 5 == 0, "Python").otherwise("any")).alias("languages"), F.when(kind == "secrets", 1).otherwise(0).alias("value_group"))


# --- manifests, one per order ---------------------------------------------

_REQUIREMENTS = ("requests==2.", "{a}", ".0\n# comment\n\n-r base.txt\nflask>=1.", "{a}",
                 ",<2\n  numpy  \na<2,>=1\nb ; python_version=='3'\npkg-", "{cust}", " ~= 1.", "{a}", " , !=1.2\nlast!=9")
_PACKAGE_JSON = (
    ('{"name":"x","dependencies":{"left":"^1.', "{a}", '.0","pkg-', "{cust}", '":"~2"},"devDependencies":{"left":">=3"},'
     '"peerDependencies":{"right":"<=4 || 5"}}'),
    ('{"devDependencies":{"only-dev":"1.', "{a}", '"}}'),
    ("{}",),
    ("{broken", "{cust}"),
)


def requirements(spark, sf_dir):
    fill = {"{a}": _text(F.col("o_orderkey") % 30), "{cust}": _text("o_custkey")}
    return dealt(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey").select(
        F.concat(F.lit("order-"), _text("o_orderkey")).alias("scan_id"),
        _concat(*[fill.get(p, p) for p in _REQUIREMENTS]).alias("content"))


def package_json(spark, sf_dir):
    fill = {"{a}": _text(F.col("o_orderkey") % 30), "{cust}": _text("o_custkey")}
    texts = [_concat(*[fill.get(p, p) for p in s]) for s in _PACKAGE_JSON]
    return dealt(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey").select(
        F.concat(F.lit("order-"), _text("o_orderkey")).alias("scan_id"),
        F.element_at(F.array(*texts), (F.col("o_orderkey") % len(texts) + 1).cast("int")).alias("content"))


SQL["thin_manifests"] = """SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS scan_id, CASE o_orderkey % 4
  WHEN 0 THEN '# nothing' || chr(10) || '  ' || chr(10) || '-r base.txt' WHEN 1 THEN '' WHEN 2 THEN chr(10) || '   # c' || chr(10) || 'pkg-' || CAST(o_custkey AS VARCHAR)
  ELSE lower(o_orderpriority) END AS content FROM orders"""


def thin_manifests(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(
        F.concat(F.lit("order-"), _text("o_orderkey")).alias("scan_id"),
        F.when(k == 0, "# nothing\n  \n-r base.txt").when(k == 1, "").when(k == 2, _concat("\n   # c\npkg-", _text("o_custkey")))
        .otherwise(F.lower("o_orderpriority")).alias("content"))


_MANIFEST_FILL = {"{a}": ("CAST(o_orderkey % 30 AS VARCHAR)",), "{cust}": ("CAST(o_custkey AS VARCHAR)",)}
SQL["requirements"] = ("SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS scan_id, "
                       + _concat_sql(*[_MANIFEST_FILL.get(p, p) for p in _REQUIREMENTS]) + " AS content FROM orders")
SQL["package_json"] = (
    "SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS scan_id, CASE o_orderkey % 4 "
    + " ".join(f"WHEN {i} THEN " + _concat_sql(*[_MANIFEST_FILL.get(p, p) for p in s]) for i, s in enumerate(_PACKAGE_JSON))
    + " END AS content FROM orders")


# --- dependencies, one per order line -----------------------------------------

SQL["deps"] = """SELECT 'order-' || CAST(l_orderkey AS VARCHAR) AS scan_id, l_linenumber AS ordinal,
  CASE WHEN l_suppkey % 3 = 0 THEN 'PKG_' ELSE 'pkg-' END || CAST(l_partkey AS VARCHAR) AS name,
  CASE WHEN l_linenumber = 6 THEN '' ELSE
    CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR) || '.' || CAST(l_suppkey % 10 AS VARCHAR)
    || CASE WHEN l_linenumber % 3 = 0 THEN 'rc1' ELSE '.' || CAST(l_linenumber AS VARCHAR) END END AS version,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_partkey % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem
FROM lineitem"""


def deps(spark, sf_dir):
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return spread(lines, "l_orderkey", "l_linenumber").select(
        F.concat(F.lit("order-"), _text("l_orderkey")).alias("scan_id"), line.alias("ordinal"),
        _concat(F.when(F.col("l_suppkey") % 3 == 0, "PKG_").otherwise("pkg-"), _text(part)).alias("name"),
        F.when(line == 6, "").otherwise(_concat(
            _text(F.col("l_quantity").cast("int") % 4), ".", _text(F.col("l_suppkey") % 10),
            F.when(line % 3 == 0, "rc1").otherwise(_concat(".", _text(line))))).alias("version"),
        F.when(line == 7, F.lit(None)).when(part % 2 == 0, "PyPI").otherwise("npm").alias("ecosystem"))


SQL["dep_requests"] = """SELECT 'order-' || CAST(o_orderkey AS VARCHAR) AS scan_id, CASE o_orderkey % 5 WHEN 0 THEN [] WHEN 1 THEN NULL
  ELSE ['pkg-' || CAST(o_custkey AS VARCHAR)] END AS dependencies FROM orders"""


def dep_requests(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(
        _concat("order-", _text(key)).alias("scan_id"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 5 != 1, F.array(_concat("pkg-", _text("o_custkey")))).alias("dependencies"))


# One name with the versions of all order lines, and an advisory for each part with a range of its versions.
SQL["one_name"] = """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, l_partkey % 100 AS b, l_linenumber AS c FROM lineitem"""
SQL["one_name_ranges"] = """SELECT 'GHSA-' || CAST(p_partkey AS VARCHAR) AS advisory_id, p_partkey % 50 + 1 AS a, p_partkey * 7 % 100 AS b,
  p_partkey % 50 + 1 + p_partkey % 3 // 2 AS to_a, p_partkey * 7 % 100 + 1 AS to_b, p_partkey % 2 = 0 AS fixed FROM part"""


def one_name_deps(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return spread(lines, "l_orderkey", "l_linenumber").select(
        F.concat(F.lit("order-"), _text("l_orderkey")).alias("scan_id"), F.col("l_linenumber").alias("ordinal"), F.lit("hot").alias("name"),
        F.concat_ws(".", _text(F.col("l_quantity").cast("int")), _text(F.col("l_partkey") % 100), _text("l_linenumber")).alias("version"),
        F.lit("npm").alias("ecosystem"))


def one_name_advisories(spark, sf_dir):
    p = F.col("p_partkey")
    upper = F.when(p % 3 == 2, p % 50 + 2).otherwise(p % 50 + 1)
    return dealt(table(spark, sf_dir, "part", "p_partkey"), "p_partkey").select(_concat(
        '{"id":"GHSA-', _text(p), '","affected":[{"package":{"ecosystem":"npm","name":"hot"},"ranges":[{"type":"SEMVER","events":[{"introduced":"',
        _text(p % 50 + 1), ".", _text(p * 7 % 100), '.2"},{"', F.when(p % 2 == 0, "fixed").otherwise("last_affected"), '":"',
        _text(upper), ".", _text(p * 7 % 100 + 1), '.1"}]}]}]}').alias("record"))


# Versions in their published order, fixed values; those of one inner tuple are equal.
VERSION_ORDERS = {
    "Maven": (("1.0-alpha-1", "1-alpha1", "1.0.a1"), ("1.0-beta-2",), ("1.0-milestone-1", "1.0-m1"), ("1.0-rc1", "1.0-cr1"), ("1.0-SNAPSHOT",),
              ("1.0", "1", "1.0.0", "1.0.Final", "1.0-ga", "1.0.RELEASE"), ("1.0-sp1",), ("1.0-jre",), ("1.0-xyz",), ("1-1", "1.0-1"), ("1.0.1",),
              ("1.2",), ("1.10",), ("31.1-jre",), ("32.0.0-android",), ("32.0.0-jre",), ("32.0.1-jre",)),
    "Go": (("v0.0.0-20190101000000-aaaaaaaaaaaa",), ("v0.0.0-20191109021931-daa7c04131f5",), ("v0.1.0",), ("v1.2.3-pre",),
           ("v1.2.3-pre.0.20191109021931-daa7c04131f5",), ("v1.2.3",), ("v1.2.4-0.20191109021931-daa7c04131f5",), ("v1.2.4",),
           ("v2.0.0+incompatible", "v2.0.0"), ("v10.0.0",)),
    "RubyGems": (("1.0.a",), ("1.0.a.2",), ("1.0.a10",), ("1.0.b1",), ("1.0-rc1", "1.0.pre.rc1"), ("1.0.rc1",), ("1.0", "1", "1.0.0"), ("1.0.1",),
                 ("1.2.pre1",), ("1.2",), ("1.10",), ("2.0.0.rc2",), ("2",)),
    "NuGet": (("1.0.0-alpha", "1.0.0-ALPHA"), ("1.0.0-alpha.1",), ("1.0.0-beta.2",), ("1.0.0-beta.11",), ("1.0.0-rc.1",),
              ("1.0.0", "1.0", "1.0.0.0", "1.0.0+metadata"), ("1.0.0.1",), ("1.0.1",), ("1.10.0",), ("2.0.0-preview1",), ("2.0.0",)),
    "npm": (("1.0.0-alpha",), ("1.0.0-alpha.1",), ("1.0.0-alpha.beta",), ("1.0.0-beta",), ("1.0.0-beta.2",), ("1.0.0-beta.11",), ("1.0.0-rc.1",),
            ("1.0.0", "v1.0.0"), ("1.0.1",), ("1.10.0",)),
    "PyPI": (("1.0.dev1",), ("1.0a1",), ("1.0b1",), ("1.0rc1", "1.0.c1"), ("1.0", "1"), ("1.0.post1", "1.0-r1"), ("1.0.1",), ("1.10",), ("1!0.5",)),
}
_ORDERED = [(eco, v, i + 1) for eco, order in VERSION_ORDERS.items() for i, equal in enumerate(order) for v in equal]

SQL["ordered_versions"] = ("SELECT o_orderkey, ecosystem, version, rank FROM (SELECT o_orderkey, o_orderkey % " + str(len(_ORDERED)) + " AS k FROM orders) JOIN (VALUES "
                           + ", ".join(f"({i}, {quote(e)}, {quote(v)}, {r})" for i, (e, v, r) in enumerate(_ORDERED)) + ") AS t(k, ecosystem, version, rank) USING (k)")


def ordered_versions(spark, sf_dir):
    """(ecosystem, version) for each order, dealt from the lists above."""
    at = F.col("o_orderkey")
    return spread(table(spark, sf_dir, "orders", "o_orderkey"), "o_orderkey").select(
        _choose([e for e, _, _ in _ORDERED], at).alias("ecosystem"), _choose([v for _, v, _ in _ORDERED], at).alias("version"))


# Packages of the report queries: one per part, in the scans of the documents.
SQL["report_deps"] = """SELECT 'scan-src' || CAST(p_partkey % 20 AS VARCHAR) AS scan_id, p_partkey AS ordinal,
  'pkg-' || CAST(p_partkey // 3 AS VARCHAR) AS name,
  CAST(p_size % 4 AS VARCHAR) || '.' || CAST(p_partkey % 10 AS VARCHAR) AS version,
  CASE WHEN (p_partkey // 3) % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem
FROM part"""


def report_deps(spark, sf_dir):
    part = F.col("p_partkey")
    third = F.floor(part / 3).cast("long")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select(
        _concat("scan-src", _text(part % 20)).alias("scan_id"), part.alias("ordinal"),
        _concat("pkg-", _text(third)).alias("name"),
        _concat(_text(F.col("p_size") % 4), ".", _text(part % 10)).alias("version"),
        F.when(third % 2 == 0, "PyPI").otherwise("npm").alias("ecosystem"))


# --- advisories, one per part; NVD records, one per supplier; CVE requests -------

_SEVERITY = (
    ',"severity":[{"type":"CVSS_V3","score":"9.8"}]',
    ',"severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L"}],"database_specific":{"severity":"MODERATE"}',
    ',"severity":[{"type":"CVSS_V2","score":"7.5/AV:N"}]',
    ',"database_specific":{"cvss_score":4.5}',
    ',"database_specific":{"severity":""}',
    "",
    ',"severity":[{"score":"abc"},{"score":"9d"},{"score":"3.9"}]',
    ',"database_specific":{"severity":"weird","cvss_score":9.9}',
    ',"database_specific":{"severity":"none"}',
    ',"database_specific":{"cvss_score":"8.1"}',
)
_ALIASES = (',"aliases":["GHSA-x","CVE-2020-{p}"]', ',"aliases":["cve-2020-1","PYSEC-1"]', "", ',"aliases":[]')
_VERSIONS = (
    '"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"1.{d}"}]}]',
    '"ranges":[{"type":"SEMVER","events":[{"introduced":"1.2"},{"fixed":"2.{d}.0"},{"introduced":"3.0"},{"last_affected":"3.5.1"}]}]',
    '"versions":["1.{d}.1","2.3.2","0.5.4"]',
    '"ranges":[{"type":"GIT","events":[{"introduced":"0"}]}]',
)
_REFERENCES = tuple(
    '{"type":"WEB","url":"' + ("" if i % 3 == 2 else f"https://example.com/r{i}") + '"}' for i in range(12))


def osv_records(spark, sf_dir):
    p = F.col("p_partkey")
    half = F.floor(p / 2).cast("long")
    number = lambda c: F.replace(F.replace(c, F.lit("{p}"), _text(p)), F.lit("{d}"), _text(p % 10))
    own = F.when(p % 9 == 0, "LOW").when(p % 9 == 1, "CRITICAL")
    record = _concat(
        '{"id":"', F.when(p % 10 == 0, _concat("CVE-2021-", _text(p + 10000))).otherwise(_concat("GHSA-", _text(p))), '"',
        number(_choose(_ALIASES, p)), _choose(_SEVERITY, p),
        F.when(p % 5 == 0, "").otherwise(_concat(',"summary":"', F.col("p_name"), '"')),
        ',"published":"2021-01-0', _text(p % 9 + 1), 'T00:00:00Z","modified":"2022-02-01T00:00:00Z","affected":[{"package":{"ecosystem":"',
        F.when(half % 2 == 0, "PyPI").otherwise("npm"), '","name":"pkg-', _text(half), '"},',
        number(_choose(_VERSIONS, p)),
        F.when(own.isNotNull(), _concat(',"database_specific":{"severity":"', F.coalesce(own, F.lit("")), '"}')).otherwise(""),
        "}", F.when(p % 6 == 0, ',{"package":{"name":"bare"}},{"package":{"ecosystem":"Go"}}').otherwise(""),
        '],"references":[', F.array_join(F.slice(F.array(*[F.lit(r) for r in _REFERENCES]), F.lit(1), (p % 12).cast("int")), ","), "]}")
    return dealt(table(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey").select(record.alias("record"))


SQL["osv"] = (
    "SELECT p_partkey AS p, '{\"id\":\"' || CASE WHEN p_partkey % 10 = 0 THEN 'CVE-2021-' || CAST(p_partkey + 10000 AS VARCHAR) "
    "ELSE 'GHSA-' || CAST(p_partkey AS VARCHAR) END || '\"' || "
    f"replace({_choose_sql(_ALIASES, 'p_partkey')}, '{{p}}', CAST(p_partkey AS VARCHAR)) || {_choose_sql(_SEVERITY, 'p_partkey')} || "
    "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ',\"summary\":\"' || p_name || '\"' END || "
    "',\"published\":\"2021-01-0' || CAST(p_partkey % 9 + 1 AS VARCHAR) || "
    "'T00:00:00Z\",\"modified\":\"2022-02-01T00:00:00Z\",\"affected\":[{\"package\":{\"ecosystem\":\"' || "
    "CASE WHEN (p_partkey // 2) % 2 = 0 THEN 'PyPI' ELSE 'npm' END || '\",\"name\":\"pkg-' || CAST(p_partkey // 2 AS VARCHAR) || '\"},' || "
    f"replace({_choose_sql(_VERSIONS, 'p_partkey')}, '{{d}}', CAST(p_partkey % 10 AS VARCHAR)) || "
    "CASE p_partkey % 9 WHEN 0 THEN ',\"database_specific\":{\"severity\":\"LOW\"}' "
    "WHEN 1 THEN ',\"database_specific\":{\"severity\":\"CRITICAL\"}' ELSE '' END || '}' || "
    "CASE WHEN p_partkey % 6 = 0 THEN ',{\"package\":{\"name\":\"bare\"}},{\"package\":{\"ecosystem\":\"Go\"}}' ELSE '' END || "
    f"'],\"references\":[' || array_to_string(list_slice({sql_list(_REFERENCES)}, 1, p_partkey % 12), ',') || ']}}' AS record FROM part")

_DESCRIPTIONS = (
    '[{"lang":"es","value":"hola"},{"lang":"en","value":"supplier {s}"},{"lang":"en","value":"second"}]',
    '[{"lang":"es","value":"hola"}]',
    "[]",
)


def nvd_responses(spark, sf_dir):
    s = F.col("s_suppkey")
    found = _concat('{"vulnerabilities":[{"cve":{"id":"CVE-2022-', _text(s + 10000),
                    '","published":"2022-03-01T00:00:00.000","lastModified":"2022-04-01T00:00:00.000","descriptions":',
                    F.replace(_choose(_DESCRIPTIONS, s), F.lit("{s}"), _text(s)), "}}]}")
    return table(spark, sf_dir, "supplier", "s_suppkey").select(
        F.when(s % 7 == 6, '{"vulnerabilities":[]}').otherwise(found).alias("response"))


SQL["nvd"] = (
    "SELECT CASE WHEN s_suppkey % 7 = 6 THEN '{\"vulnerabilities\":[]}' ELSE '{\"vulnerabilities\":[{\"cve\":{\"id\":\"CVE-2022-' || "
    "CAST(s_suppkey + 10000 AS VARCHAR) || '\",\"published\":\"2022-03-01T00:00:00.000\",\"lastModified\":\"2022-04-01T00:00:00.000\","
    f"\"descriptions\":' || replace({_choose_sql(_DESCRIPTIONS, 's_suppkey')}, '{{s}}', CAST(s_suppkey AS VARCHAR)) || '}}}}]}}' END AS response FROM supplier")

SQL["cve_requests"] = """SELECT c_custkey AS request_id, c_custkey % 2 = 0 AS include_technical, CASE c_custkey % 6
  WHEN 0 THEN 'CVE-2021-' || CAST(10000 + c_custkey % 2000 AS VARCHAR)
  WHEN 1 THEN 'cve-2022-' || CAST(10000 + c_custkey % 150 AS VARCHAR)
  WHEN 2 THEN 'CVE-21-' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN 'CVE-2021-44228'
  WHEN 4 THEN 'Cve-2021-10010' ELSE 'CVE-2021-123' END AS cve_id FROM customer"""


def cve_requests(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer", "c_custkey").select(
        c.alias("request_id"), (c % 2 == 0).alias("include_technical"),
        F.when(c % 6 == 0, _concat("CVE-2021-", _text(c % 2000 + 10000)))
        .when(c % 6 == 1, _concat("cve-2022-", _text(c % 150 + 10000)))
        .when(c % 6 == 2, _concat("CVE-21-", _text(c))).when(c % 6 == 3, "CVE-2021-44228")
        .when(c % 6 == 4, "Cve-2021-10010").otherwise("CVE-2021-123").alias("cve_id"))


# --- scan log and messages, one per event ------------------------------------------

SQL["scan_log"] = """SELECT 'scan-' || CAST(user_id AS VARCHAR) AS scan_id, ts, event_id AS seq, event_type AS type,
  CAST(floor(value) AS BIGINT) AS n_findings FROM events"""


def scan_log(spark, sf_dir):
    return table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type", "value").select(
        _concat("scan-", _text("user_id")).alias("scan_id"), "ts", F.col("event_id").alias("seq"),
        F.col("event_type").alias("type"), F.floor("value").cast("long").alias("n_findings"))


SQL["messages"] = """SELECT 'ev-' || CAST(event_id AS VARCHAR) AS scan_id, ts, event_id, event_type, CASE event_id % 4
  WHEN 0 THEN '{"code":"eval(x)","language":"' || event_type || '","scan_types":["code","owasp"]}'
  WHEN 1 THEN props WHEN 2 THEN '{"code": "broken'
  ELSE '{"code":"y","scan_types":["owasp","zap","secrets","x"]}' END AS payload FROM events"""


def message_columns() -> list[Column]:
    e = F.col("event_id")
    return [
        _concat("ev-", _text(e)).alias("scan_id"), F.col("ts"),
        F.when(e % 4 == 0, _concat('{"code":"eval(x)","language":"', F.col("event_type"), '","scan_types":["code","owasp"]}'))
        .when(e % 4 == 1, F.col("props")).when(e % 4 == 2, '{"code": "broken')
        .otherwise('{"code":"y","scan_types":["owasp","zap","secrets","x"]}').alias("payload"),
    ]


def messages(spark, sf_dir):
    return spread(table(spark, sf_dir, "events", "event_id", "ts", "event_type", "props"), "event_id").select(*message_columns())
