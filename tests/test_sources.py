from pyspark.sql import functions as F

from codesieve.sources.files import decode_files, flag_oversize, oversize_files, read_directory, submitted_code
from codesieve.sources.manifests import parse_package_json, parse_requirements
from codesieve.sources.scanner_reports import parse_bearer, parse_gitleaks, parse_trufflehog


def one(spark, text, name="content"):
    return spark.createDataFrame([("s", text)], f"scan_id string, {name} string")


def test_requirements(spark):
    text = ("requests==2.25.0\nflask>=1.0,<2\na<2,>=1\nb ; python_version=='3'\n# c\n-r x\n\n  numpy  \n"
            "x~=1.4\r\ny != 2 , <3\nz>1\nw<=5")
    got = [(r.name, r.version) for r in parse_requirements(one(spark, text)).orderBy("ordinal").collect()]
    assert got == [("requests", "2.25.0"), ("flask", "1.0"), ("a<2,", "1"), ("b ; python_version", "'3'"), ("numpy", ""),
                   ("x", "1.4"), ("y", "2 "), ("z", "1"), ("w", "5")]


def test_package_json(spark):
    text = '{"dependencies":{"a":"^1.2.0"},"devDependencies":{"a":"~2","b":">=1 <2"},"peerDependencies":{"c":"*"}}'
    got = [(r.name, r.version, r.ecosystem) for r in parse_package_json(one(spark, text)).orderBy("ordinal").collect()]
    assert got == [("a", "1.2.0", "npm"), ("a", "2", "npm"), ("b", "1 <2", "npm"), ("c", "*", "npm")]
    repeated = '{"dependencies":{"a":"^1","b":"2","a":"3"},"devDependencies":{"a":"4"}}'
    assert [(r.name, r.version, r.section) for r in parse_package_json(one(spark, repeated)).orderBy("ordinal").collect()] == [
        ("a", "3", "dependencies"), ("b", "2", "dependencies"), ("a", "4", "devDependencies")]
    assert parse_package_json(one(spark, "{broken")).count() == 0
    assert parse_package_json(one(spark, '{"name":"x"}')).count() == 0


def test_gitleaks(spark):
    single = parse_gitleaks(one(spark, '{"RuleID":"r","Secret":"abcdef","Match":"0123456789abcdefgh","StartLine":3}', "report")).collect()
    assert [(r.id, r.type, r.description, r.masked_value, r.line_number, r.confidence) for r in single] == [
        ("gl-0123456789abcdef", "r", "r", "**cdef", 3, 0.95)]
    assert parse_gitleaks(one(spark, "[]", "report")).count() == 0
    assert parse_gitleaks(one(spark, "no json", "report")).count() == 0
    bare = parse_gitleaks(one(spark, "[{}]", "report")).collect()[0]
    assert (bare.id, bare.type, bare.description, bare.masked_value) == ("gl-", "unknown", "Secret detected by gitleaks", "")


def test_trufflehog(spark):
    text = ('{"Raw":"abcdef","DetectorName":"AWS","Verified":true,"SourceMetadata":{"Data":{"Filesystem":{"file":"a.py","line":0}}}}\n'
            "\n{bad\n"
            '{"RawV2":"zz","SourceMetadata":{"Data":{"Git":{"file":"g.py","lineNumber":"7"}}}}\n{"StructuredData":{"id":"sd"}}')
    got = [(r.id, r.type, r.masked_value, r.reported_path, r.line_number, r.confidence)
           for r in parse_trufflehog(one(spark, text, "report")).collect()]
    assert sorted(got) == sorted([
        ("th-abcdef", "AWS", "**cdef", "a.py", None, 1.0), ("th-zz", "Unknown", "**", "g.py", 7, 0.0),
        ("th-sd", "Unknown", "****", None, None, 0.0)])


def test_bearer(spark):
    text = ('{"warning":[{"rule_id":"w","source":{"start":4},"cwe_ids":["89"],"owasp":{"name":"A03"}}],"odd":[{"owasp":"x"}],'
            '"high":"text"}')
    got = {r.id: (r.severity, r.title, r.line_number, r.cwe_id, r.owasp_category)
           for r in parse_bearer(one(spark, text, "report")).collect()}
    assert got == {"bearer-w": ("low", "w", 4, "89", "A03"), "bearer-unknown": ("medium", "Bearer finding", None, None, None)}
    assert parse_bearer(one(spark, "[1]", "report")).count() == 0


def test_directory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b"ab\xff\xfecd")
    (tmp_path / "sub" / "b.CPP").write_text("strcpy(a, b);")
    (tmp_path / "big.txt").write_text("x" * 100)
    got = {r.file_path.rsplit("/", 1)[-1]: (r.language, r.code) for r in read_directory(spark, str(tmp_path), size_cap=50).collect()}
    assert got == {"a.py": ("python", "abcd"), "b.CPP": ("cpp", "strcpy(a, b);")}
    assert read_directory(spark, str(tmp_path)).count() == 3


def test_submitted_code(spark):
    df = spark.createDataFrame([(None, "Python"), ("a/b.js", "JavaScript"), ("", None)], "file_path string, language string")
    assert {(r.file_path, r.language) for r in submitted_code(df).collect()} == {
        ("<stdin.python>", "python"), ("a/b.js", "javascript"), ("<stdin.python>", "python")}
    assert {r.file_path for r in submitted_code(df, for_secrets=True).collect()} == {"<stdin>", "a/b.js"}


def test_size_flag_counts_bytes(spark):
    df = spark.createDataFrame([("é" * 3,), ("abc",)], "code string")
    assert [r.within_cap for r in flag_oversize(df, 5).orderBy("n_bytes").collect()] == [True, False]


def test_decode_files_keeps_unknown_suffixes(spark):
    df = spark.createDataFrame([("x/readme.md", bytearray(b"hi"))], "path string, content binary")
    assert [(r.language, r.code) for r in decode_files(df).collect()] == [("text", "hi")]


def test_empty_manifests_are_flagged(spark):
    from codesieve.sources.manifests import flag_empty_requirements
    for text, empty in (("# a\n\n-r b", True), ("", True), (None, True), ("# a\n numpy", False)):
        row = flag_empty_requirements(one(spark, text)).collect()[0]
        assert (row.reason is not None) == empty


def test_oversize_files_are_rejects(spark, tmp_path):
    for name, n in (("a.py", 3), ("b.py", 10), ("c.py", 11)):
        (tmp_path / name).write_text("x" * n)
    kept = read_directory(spark, str(tmp_path), size_cap=10).collect()
    out = oversize_files(spark, str(tmp_path), size_cap=10).collect()
    assert sorted(len(r.code) for r in kept) == [3, 10]
    assert [(r.file_path.rsplit("/", 1)[1], r.n_bytes, r.reason) for r in out] == [("c.py", 11, "larger than 10 bytes")]


def test_white_space_of_manifests(spark):
    """Lines and names are stripped as str.strip does, without a pattern."""
    from codesieve.sources.manifests import WHITE_SPACE, _strip
    assert sorted(WHITE_SPACE) == [chr(i) for i in range(0x110000) if chr(i).isspace()]
    texts = ["", " ", *(f"{c}a{c} b{c}{c}" for c in WHITE_SPACE), "\u200ba\u200b", WHITE_SPACE + "x\u180e" + WHITE_SPACE]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", _strip(F.col("t")).alias("s"))
    assert [r.s for r in got.orderBy("i").collect()] == [t.strip() for t in texts]
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
