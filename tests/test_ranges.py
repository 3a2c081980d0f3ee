"""Texts of many scans in few files."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codesieve.sinks import ranges
from codesieve.sinks.ranges import read_index, read_texts, write_ranges


@pytest.mark.parametrize("n_scans,hot", [(3000, 0), (40, 4000), (1, 50)])
def test_ranges_hold_every_scan(spark, tmp_path, n_scans, hot):
    rng, path, rows = random.Random(n_scans), str(tmp_path / "out"), []
    for i in range(n_scans):
        rows += [(f"s{i}", k, rng.choice(["", "é漢", "two\nlines", "x" * rng.randrange(40)])) for k in range(rng.randint(1, 3))]
    rows += [("hot", k, f"line {k}") for k in range(hot)] + [(None, 0, "no key"), ("s0", 99, None)]
    rng.shuffle(rows)
    # Small ranges are put together by size, if Spark may.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not hot).lower())
    write_ranges(spark.createDataFrame(rows, "scan_id string, k int, html string").repartition(5), path, "html", ["k"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {}
    for scan, _, text in sorted((r for r in rows if r[2] is not None), key=lambda r: r[1]):
        want[scan] = want.get(scan, "") + text + "\n"
    got = {}
    for r in sorted(read_texts(spark, path).collect(), key=lambda r: r.piece):
        got[r.key] = got.get(r.key, "") + r.text
    assert got == want
    assert len(list(Path(path, "text").glob("range=*/*.txt"))) <= 8  # the shuffle partitions of the test session
    one = sorted(read_texts(spark, path, ["s0"]).collect(), key=lambda r: r.piece)
    assert "".join(r.text for r in one) == want["s0"] and {r.key for r in one} == {"s0"}
    assert read_texts(spark, path, [None]).collect()[0].text == "no key\n"
    assert read_texts(spark, path, ["unknown"]).collect() == []
    if hot:
        assert read_index(spark, path).where(F.col("key") == "hot").count() > 1


def test_files_keep_their_size(spark, tmp_path, monkeypatch):
    """More lines make more files and not larger ones, whatever the number of shuffle partitions."""
    monkeypatch.setattr(ranges, "FILE_BYTES", 1000)
    path = str(tmp_path / "out")
    lines = spark.range(5000).select(F.format_string("s%03d", F.col("id") % 70).alias("scan_id"), "id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("html"))
    write_ranges(lines, path, "html", ["id"])
    sizes = [f.stat().st_size for f in Path(path, "text").glob("range=*/*.txt")]
    assert len(sizes) > 40 and max(sizes) < 1300
    got = {}
    for r in sorted(read_texts(spark, path).collect(), key=lambda r: r.piece):
        got[r.key] = got.get(r.key, "") + r.text
    assert got == {f"s{k:03d}": "".join(f"line {i}\n" for i in range(k, 5000, 70)) for k in range(70)}
