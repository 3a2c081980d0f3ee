import math

import pytest
from pyspark.sql import functions as F

import brute
from codesieve.functions import severity as sev
from codesieve.functions import text as tx
from codesieve.functions.advisory import valid_cve_id
from codesieve.functions.versions import normal_name, version_key
from codesieve.plans.inputs import VERSION_ORDERS


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_masks(spark):
    values = ["", "abc", "abcd", "abcdef", "héllo wörld", "x" * 40]
    assert column(spark, values, "string", tx.mask_tail) == [brute.mask(v) for v in values]
    bullet = "\u2022"
    assert column(spark, ["", None, "12345678", "abcdefghij", "a" * 4 + "b" * 30 + "c" * 4], "string", tx.mask_middle) == [
        "", "", bullet * 8, "abcd" + bullet * 2 + "ghij", "aaaa" + bullet * 12 + "cccc"]


def test_entropy(spark):
    values = ["a", "ab", "aabb", "0123456789abcdef", "f33e61083db5dbdf"]
    for got, value in zip(column(spark, values, "string", tx.shannon_entropy), values):
        assert math.isclose(got, brute.entropy(value), abs_tol=1e-9)


def test_decode_drops_invalid_bytes_only(spark):
    raw = [b"ab\xff\xfecd", "é\ufffdü".encode() + b"\xe2\x82", b"", b"\xed\xa0\x80x", bytes(range(256))]
    got = column(spark, [bytearray(b) for b in raw], "binary", tx.decode_utf8)
    assert got == [b.decode("utf-8", errors="ignore") for b in raw]


def test_split_lines(spark):
    values = ["a\nb", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "\n\n", "x"]
    assert column(spark, values, "string", tx.split_lines) == [v.splitlines() for v in values]


def test_cvss_and_labels(spark):
    assert column(spark, [9.0, 8.9, 7.0, 4.0, 3.9, 0.0], "double", sev.cvss_severity) == [
        "critical", "high", "high", "medium", "low", "low"]
    assert column(spark, ["critical", "Moderate", "NONE", "odd", ""], "string", sev.label_severity) == [
        "critical", "medium", "info", "medium", "medium"]
    assert column(spark, ["9.8", "9.8/AV:N", "CVSS:3.1/AV:N", "9d", "", " 7.5 ", "abc", "1e1"], "string", sev.parse_score) == [
        9.8, 9.8, None, None, None, 7.5, None, 10.0]


def test_risk(spark):
    df = spark.createDataFrame([("a", "critical"), ("a", "low"), ("b", None), ("c", "info")], "k string, s string")
    got = {r.k: r.r for r in df.groupBy("k").agg(sev.risk_score(F.col("s")).alias("r")).collect()}
    assert got == {"a": 5.5, "b": 0.0, "c": 0.0}
    assert column(spark, [7.0, 4.0, 1.0, 0.5], "double", sev.risk_band) == ["critical", "high", "medium", "low"]
    assert column(spark, [7.0, 4.25, 1.0, 0.5], "double", sev.risk_label) == ["7.0/10", "4.3/10", "1.0/10", "0.0/10"]


def test_cve_ids(spark):
    values = ["cve-2021-44228", "CVE-21-1", "CVE-2021-123", "CVE-2021-12345", "CVE-2021-1234\n", " CVE-2021-1234", None]
    assert column(spark, values, "string", valid_cve_id) == [True, False, False, True, False, False, False]


@pytest.mark.parametrize("ordered", [
    ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.2", "1.10", "2", "10.0.0", "20210101120000"],
    ["0.9", "1.0.0-alpha.1", "1.0.0-beta.2", "v1.0", "1.0.1"],
])
def test_version_order(spark, ordered):
    keys = column(spark, ordered, "string", version_key)
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_equal_versions(spark):
    a, b, c, d, none = column(spark, ["1.0", "1", "1.0.0", "v1+build5", "latest"], "string", version_key)
    assert a == b == c == d and none is None


def test_names(spark):
    df = spark.createDataFrame([("PyPI", "My_Pkg.x"), ("npm", "My_Pkg.x")], "e string, n string")
    assert [r.o for r in df.select(normal_name(F.col("e"), F.col("n")).alias("o")).collect()] == ["my-pkg-x", "My_Pkg.x"]


def test_severity_normalise(spark):
    df = spark.createDataFrame([("HIGH", None), ("", "Low"), (None, None), (None, "")], "s string, l string")
    got = [r.o for r in df.select(sev.severity_normalise(F.col("s"), F.col("l")).alias("o")).collect()]
    assert got == ["high", "low", "info", "info"]


def _order(spark, versions, ecosystem):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "i int, v string")
    keys = {r.i: r.k for r in df.select("i", version_key(F.col("v"), F.lit(ecosystem)).alias("k")).collect()}
    return sorted(range(len(versions)), key=lambda i: keys[i] or ""), keys


def test_published_version_orders(spark):
    # The examples of the semantic versioning standard, and pre-releases that look like post-releases elsewhere.
    npm = ["1.0.0-1", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-post", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "2.0.0"]
    assert _order(spark, npm, "npm")[0] == list(range(len(npm)))
    _, keys = _order(spark, ["1.0.0", "v1.0.0", "1.0", "1.0.0+build.5", "1.0.0+other"], "NPM")
    assert len(set(keys.values())) == 1
    pypi = ["1.0.dev1", "1.0a1", "1.0b1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.10", "2013.10", "1!0.5", "1!1.0", "2!0.1", "10!0.1"]
    assert _order(spark, pypi, "PyPI")[0] == list(range(len(pypi)))
    assert _order(spark, ["", "latest", "x"], "npm")[1] == {0: None, 1: None, 2: None}


@pytest.mark.parametrize("ecosystem", list(VERSION_ORDERS))
def test_orders_of_ecosystems(spark, ecosystem):
    order = VERSION_ORDERS[ecosystem]
    versions = [v for equal in order for v in equal]
    _, keys = _order(spark, versions, ecosystem)
    ranks = sorted(set(keys.values()))
    assert None not in ranks and len(ranks) == len(order)
    assert {v: ranks.index(keys[i]) for i, v in enumerate(versions)} == {v: i for i, equal in enumerate(order) for v in equal}


def test_narrow_tables_are_dealt_by_rows(spark, monkeypatch):
    """One file with one row group is one task's work for its reader; its rows go to as many tasks as they need."""
    from codesieve import session

    monkeypatch.setattr(session, "DEALT_ROWS", 10)
    table = spark.range(1000, numPartitions=8)
    got = session.dealt(table, "id")
    assert got.rdd.getNumPartitions() == 100 and got.count() == 1000
    assert session.dealt(spark.range(5, numPartitions=8), "id").rdd.getNumPartitions() == 8
