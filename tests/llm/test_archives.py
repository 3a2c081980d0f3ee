"""Web archives: legacy records to WARC and back."""

import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import pytest

from codesieve.llm import warc
from codesieve.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, file long, at long, head string, record_id string"  # with clashing names


def brute(rows):
    best = {}
    for i, _, t in rows:
        best.setdefault(t or "", []).append(i)
    out = []
    for i, _, t in rows:
        t = (t or "").encode()
        known = [x for x in best[t.decode()] if x is not None]
        kept = max(known, default=None)
        again = len(t) >= 1000 and (i != kept)
        out.append((i, len(t), hashlib.sha1(t).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "h", "r") for r in rows], PAGES)


def test_pages_through_both_formats(spark):
    rng = random.Random(1)
    odd = ["", None, "x" * 999, "y" * 1000, "a\r\n\r\nb" * 300, "\n" * 1200, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40, "filedesc://x 0.0.0.0 1 t 9\n" * 50,
           "http://a 1.1.1.1 20240101000000 text/html 5\n" * 30, "é漢😀\u2028\x00" * 400, "z" * 3_000_000, "\r\n\r\n", "tail\r\n\r\n"]
    urls = [None, "", "http://a/b c\nd\t", "no-colon", "https://é.example/ü?q=漢", "http://x/" + "p" * 5000]
    rows = [(i, rng.choice(urls), rng.choice(odd)) for i in range(120)]
    rows += [(7, "http://again", "y" * 1000), (None, None, "y" * 1000), (None, "u", None), (-5, "http://n", "only once" * 200), (None, "http://n", "no id" * 300)]
    folder = warc.convert(spark, warc.write_arc(table(spark, rows).repartition(5)), least_bytes=1000)
    found = warc.pages(spark, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=repr)
    # of rows that share id and payload one is the response, the others name the same id
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    groups = {}
    for i, n, digest, kind, refers in got:
        groups.setdefault(digest, []).append((i, n, kind, refers))
    for members in groups.values():
        ids = [i for i, *_ in members if i is not None]
        responses = [m for m in members if m[2] == "response"]
        if members[0][1] < 1000:
            assert len(responses) == len(members)
        else:
            assert len(responses) == 1 and responses[0][0] == max(ids, default=None) and responses[0][3] is None
            assert all(m[3] == max(ids, default=None) for m in members if m[2] == "revisit")
    assert all(r.verified for r in warc.read_warc(spark, folder).collect())
    assert len({r.record_id for r in warc.read_warc(spark, folder).collect()}) == warc.read_warc(spark, folder).count()


def test_payloads_and_files(spark):
    rows = [(i, f"http://h/{i}", f"text {i}\r\n\r\n" * 200) for i in range(9)]
    folder = warc.convert(spark, warc.write_arc(table(spark, rows).coalesce(2)))
    payloads = {r.doc: bytes(r.payload).decode() for r in warc.read_warc(spark, folder, payloads=True).collect() if r.type == "response"}
    assert payloads == {i: t for i, _, t in rows}
    # the bytes on disk are WARC that a plain reader walks through by lengths
    for path in Path(folder.removeprefix("file:")).glob("part-*"):
        data, at, kinds = gzip.decompress(path.read_bytes()), 0, []
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at)
            kinds.append(warc.field(data[at:end], "WARC-Type"))
            at = end + 4 + int(warc.field(data[at:end + 2], "Content-Length"))
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4
        assert kinds[0] == "warcinfo"




def legacy(version):
    block = f"{version} 0 Archive\n{warc.ARC_FIELDS[version]}\n".encode()
    more = "200 - - 0 old.arc " if version == 2 else ""
    doc = b"HTTP/1.0 200 OK\nServer: x\n\n<p>one\nhttp://no 1 2 3 4\n</p>"
    second = "404 abc - 17 old.arc " if version == 2 else ""
    return (f"filedesc://old.arc 1.2.3.4 1997 text/plain {more}{len(block)}\n".encode() + block + b"\n"
            + f"http://a/with space.html 10.0.0.1 19970203040506 text/html {second}{len(doc)}\n".encode() + doc + b"\n\n\nrubbish line\n"
            + f"dns:a 10.0.0.1 199702030405 text/dns {second}3\nabc\n".encode()
            + f"http://cut/ 10.0.0.1 bad text/html {second}900\nHTTP/1.1 200 OK\r\n\r\ncut off here".encode())


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_versions_of_headers(version, step):
    data, reader, got = legacy(version), warc.ArcReader("k"), []
    for i in range(0, len(data), step):
        reader.bytes.feed(data[i:i + step])
        got += reader.read(False)
    got += reader.read(True)
    assert [(at, v, p[0], p[2], short) for at, _, v, p, _, short in got] == [
        (0, version, "filedesc://old.arc", "1997", False), (1, version, "http://a/with space.html", "19970203040506", False),
        (2, version, "dns:a", "199702030405", False), (3, version, "http://cut/", "bad", True)]
    assert got[1][4].endswith(b"</p>") and got[2][4] == b"abc" and got[3][4].endswith(b"cut off here")


def test_converter_on_foreign_files(spark, tmp_path):
    for version in (1, 2):
        (tmp_path / f"v{version}.arc.gz").write_bytes(gzip.compress(legacy(version)))
    folder = warc.convert(spark, f"file://{tmp_path}")
    got = sorted((r.type, r.uri, r.date, r.payload_bytes, r.verified) for r in warc.read_warc(spark, folder).collect() if r.uri)
    assert got == sorted(2 * [
        ("response", "http://a/with space.html", "1997-02-03T04:05:06Z", 29, True), ("resource", "dns:a", "1997-02-03T04:05:00Z", 3, True),
        ("response", "http://cut/", "1970-01-01T00:00:00Z", 13, True)])


def test_dates():
    assert [warc.iso_date(d) for d in ("1997", "199702", "19970203", "20240229235959", "", "x", "99990099", "20241301")] == [
        "1997-01-01T00:00:00Z", "1997-02-01T00:00:00Z", "1997-02-03T00:00:00Z", "2024-02-29T23:59:59Z", *4 * ["1970-01-01T00:00:00Z"]]


def test_no_pages(spark):
    assert warc.pages(spark, warc.convert(spark, warc.write_arc(table(spark, [])))).collect() == []


def test_query_and_sql(spark):
    df = QUERIES["op13_warc"](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op13_warc']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and want
