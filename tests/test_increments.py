"""Figures kept by increments against full recomputation, and directories of real files."""

import hashlib
import random

from pyspark.sql import functions as F

from codesieve.functions.severity import LEVELS
from codesieve.operators import summaries
from codesieve.operators.increments import dashboard, scan_counts, stats_writer
from codesieve.sinks.ranges import write_parts
from codesieve.sources.files import list_files, scan_directory

SENT = "scan_id string, seq long, severity string"


def recomputed(spark, rows):
    """Both figures from all findings of the latest sending of each scan."""
    last = {}
    for scan, seq, _ in rows:
        last[scan] = max(seq, last.get(scan, seq))
    now = [r for r in rows if last[r[0]] == r[1]]
    scans = spark.createDataFrame([(s,) for s in last], "scan_id string")
    found = spark.createDataFrame([r for r in now if r[2]], SENT)
    return (summaries.dashboard_stats(found, scans).collect()[0],
            sorted(map(tuple, summaries.severity_summary(found, scans).select("scan_id", *LEVELS).collect())))


def test_increments_equal_recomputation(spark, tmp_path):
    rng, path, rows = random.Random(8), str(tmp_path / "counts"), []
    write = stats_writer(path, buckets=3)
    assert tuple(dashboard(spark, path).collect()[0]) == (0, 0, 0, 0)
    for batch in range(3):
        # scans go on in a later batch (same seq), are sent anew (higher seq), or come too late (lower seq)
        new = [(f"s{rng.randrange(9)}", rng.randrange(batch + 1), rng.choice([*LEVELS, None, None, None])) for _ in range(25)]
        known = {}
        for scan, seq, _ in rows:
            known[scan] = max(seq, known.get(scan, seq))
        rows += new
        df = spark.createDataFrame([*new, (None, 1, "high")], SENT)
        write(df, batch)
        write(df, batch)  # replayed
        figures, counts = recomputed(spark, rows)
        assert tuple(dashboard(spark, path).collect()[0]) == tuple(figures)
        assert sorted(map(tuple, scan_counts(spark, path).collect())) == counts
    # the log of a batch that was never committed is not read
    spark.createDataFrame([(100, 100, 100, 100)], "scans long, critical long, warnings long, clean long").write.parquet(f"{path}/changes/batch_id=3")
    assert tuple(dashboard(spark, path).collect()[0]) == tuple(recomputed(spark, rows)[0])
    write(spark.createDataFrame([], SENT), 3)
    assert tuple(dashboard(spark, path).collect()[0]) == tuple(recomputed(spark, rows)[0])


def test_directory_with_rejects(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"ok \xff\xfe\xc3\xa9")
    (tmp_path / "a" / "empty.js").write_bytes(b"")
    (tmp_path / "big.c").write_bytes(b"y" * 5000)
    (tmp_path / "gone.go").write_text("soon away")
    (tmp_path / "no-suffix").write_text("z")
    listing = list_files(spark, str(tmp_path))
    assert listing.count() == 4  # not the empty one
    (tmp_path / "gone.go").unlink()
    (tmp_path / "late.py").write_text("written after the listing")
    got = {r.file_path.rsplit("/", 1)[1]: (r.n_bytes, r.language, r.code, r.status, r.reason)
           for r in scan_directory(spark, str(tmp_path), size_cap=1000, listing=listing).collect()}
    assert got == {
        "x.py": (7, "python", "ok é", "text", None), "no-suffix": (1, "text", "z", "text", None),
        "big.c": (5000, "c", None, "oversize", "larger than 1000 bytes"), "gone.go": (9, "go", None, "unreadable", "listed but not readable")}
    whole = scan_directory(spark, str(tmp_path), size_cap=1000)
    assert whole.count() == 4 and whole.where(F.col("status") == "text").count() == 3


def test_directory_of_files_in_parts(spark, tmp_path):
    """Parts are put together in name order, a letter may be cut by them, and the cap holds for the whole file."""
    parts = {"a.py": (b"x = '\xc3", b"\xa9'\n", b"end"), "b.js": (b"y" * 600, b"y" * 600), "c.go": (b"soon ", b"away"), "d.py": (b"z" * 1000,)}
    for name, texts in parts.items():
        (tmp_path / name).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / name / f"part-{i:05}").write_bytes(text)
    listing = list_files(spark, str(tmp_path), in_parts=True)
    (tmp_path / "c.go" / "part-00001").unlink()
    got = {r.file_path.rsplit("/", 1)[1]: (r.n_bytes, r.language, r.code, r.status, r.reason)
           for r in scan_directory(spark, str(tmp_path), size_cap=1000, listing=listing, in_parts=True).collect()}
    assert got == {
        "a.py": (12, "python", "x = 'é'\nend", "text", None), "b.js": (1200, "javascript", None, "oversize", "larger than 1000 bytes"),
        "c.go": (9, "go", None, "unreadable", "listed but not readable"), "d.py": (1000, "python", "z" * 1000, "text", None)}


def test_large_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("codesieve.sinks.ranges.PART_BYTES", 2000)
    texts = [(i % 3 and 7, i, f"{i:04} é" * 9) for i in range(600)]
    write_parts(spark.createDataFrame(texts, "file int, n long, text string").repartition(5), str(tmp_path / "d"), "text", "file", ["n"])
    for file in (0, 7):
        parts = sorted((tmp_path / "d" / f"file={file}").glob("part-*"))
        assert len(parts) > 5 and max(p.stat().st_size for p in parts) < 10_000
        assert b"".join(p.read_bytes() for p in parts).decode() == "".join(t + "\n" for f, _, t in texts if f == file)


def test_directory_query_cuts_its_large_file(spark, tmp_path, monkeypatch):
    """A third of the documents are one file, which no single task may write."""
    import __spark_entry__
    monkeypatch.setattr("codesieve.sinks.ranges.PART_BYTES", 20_000)
    folders = []
    monkeypatch.setattr("codesieve.plans.scan_queries.shared_folder", lambda *a: folders.append(str(tmp_path / "files")) or folders[-1])
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.bucket: r for r in __spark_entry__.queries()["src_directory_files"](spark, str(tmp_path)).collect()}
    assert len(got) == 200 and len(list((tmp_path / "files" / "bucket=0").glob("part-*"))) > 3
    text = "".join("word " * (i % 40) + "\n" for i in range(3000) if i % 3 == 0 or i % 200 == 0)
    assert (got[0].n_bytes, got[0].status) == (len(text), "oversize")
    text = "".join("word " * (i % 40) + "\n" for i in range(1, 3000, 200) if i % 3)
    assert (got[1].n_bytes, got[1].status, got[1].code_hash) == (len(text), "text", hashlib.sha256(text.encode()).hexdigest())
