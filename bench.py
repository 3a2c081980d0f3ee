"""Time the headline queries; prints one JSON line.

Every query runs once to warm up and is then timed writing all its rows to the
noop sink.  ``kernel_57_rules`` is the match kernel alone: all code and OWASP
patterns on every text of a cached table, with line numbers.  BENCH_SF_DIR and
BENCH_CPUS set the data and the cores; arguments name other queries to time
("all" for every one).
"""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace

from codesieve.operators.matching import locate
from codesieve.plans import QUERIES, inputs
from codesieve.rules import CODE_RULES, OWASP_RULES
from codesieve.session import local_session

HEADLINE = (
    "kernel_57_rules",
    "code_scan", "code_snippet", "owasp_scan", "owasp_status", "secret_scan", "scan_full", "severity_summary",
    "dashboard_stats", "findings_top30", "src_requirements", "dep_advisory_join", "dep_risk", "dep_summary",
    "cve_explain_record", "report_counts", "sink_report_html", "latest_scan", "remediation_prompt", "chat_messages",
    "stream_scan",
)


def kernel_57_rules(spark, sf_dir):
    rules = [replace(r, languages=("any",)) for r in (*CODE_RULES, *OWASP_RULES)]
    files = inputs.files(spark, sf_dir).cache()
    files.count()
    return locate(files.select("file_path", "code"), rules).select("file_path", "rule_no", "line_number")


def run(name, spark, sf_dir) -> float:
    df = kernel_57_rules(spark, sf_dir) if name == "kernel_57_rules" else None
    start = time.perf_counter()
    df = df if df is not None else QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    taken = round(time.perf_counter() - start, 3)
    spark.catalog.clearCache()  # the kernel's input must not speed up other queries
    return taken


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    seconds = {}
    for name in names:
        run(name, spark, sf_dir)
        seconds[name] = run(name, spark, sf_dir)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
