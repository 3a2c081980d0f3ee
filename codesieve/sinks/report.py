"""HTML reports as ordered lines.

A report may hold any number of findings, so it is never put together in one
value.  It is a set of rows (scan, part, sort keys, html); written in key order
over ranges of the keys, the files of a scan read one after the other are its
report, and a scan that holds most findings is written by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import risk_band, risk_label, severity_color
from ..functions.text import html_escape
from ..operators.dependencies import risk_of_findings

# The order of the lines of a report.
ORDER = ("part", "kind", "k1", "k2", "k3")
HEAD, FINDINGS, SECRETS, PACKAGES, FOOT = 0, 1, 2, 3, 4
OPEN, ROW, CLOSE = 0, 1, 2

STYLE = (
    "body{font:15px/1.5 sans-serif;margin:2rem;color:#1f2937}"
    "table{border-collapse:collapse;width:100%}"
    "td,th{border:1px solid #d1d5db;padding:.4rem .6rem;text-align:left;vertical-align:top}"
    ".tag{border-radius:.3rem;padding:0 .4rem;color:#fff}"
    ".figures span{margin-right:1.5rem}"
)

# ``{name}`` stands for a column that is ready to be shown.
TEMPLATES = {
    "head": (
        '<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>{title}</title>'
        f"<style>{STYLE.replace('{', '{{').replace('}', '}}')}</style></head><body><h1>{{title}}</h1>"
        "<p>Generated: {generated} | Scan ID: {scan}</p>"
        '<p class="figures"><span>Critical {critical_count}</span><span>High {high_count}</span>'
        "<span>Medium {medium_count}</span><span>Low {low_count}</span>"
        "<span>Secrets {secrets_count}</span><span>Dep CVEs {dep_vuln_count}</span></p>"
    ),
    "findings_open": (
        "<h2>Vulnerabilities ({n})</h2><table><tr><th>Severity</th><th>Title</th><th>Category</th>"
        "<th>File / Line</th><th>CWE</th></tr>"
    ),
    "finding": (
        '<tr><td><span class="tag" style="background:{color}">{severity}</span></td>'
        "<td><strong>{title}</strong><br>{description}{snippet}{fix}</td><td>{category}</td>"
        "<td>{place}</td><td>{cwe}</td></tr>"
    ),
    "secrets_open": (
        "<h2>Detected Secrets ({n})</h2><table><tr><th>Severity</th><th>Type</th>"
        "<th>Masked Value</th><th>File / Line</th></tr>"
    ),
    "secret": (
        '<tr><td><span class="tag" style="background:{color}">{severity}</span></td><td>{type}</td>'
        "<td><code>{masked}</code></td><td>{place}</td></tr>"
    ),
    "packages_open": (
        "<h2>Dependency Risk ({n} packages)</h2><table><tr><th>Package</th><th>Version</th>"
        "<th>Risk Score</th><th>CVEs</th></tr>"
    ),
    # The cells' end tags are left out: further lines add the package's CVEs.
    "package": (
        "<tr><td>{name}</td><td><code>{version}</code></td>"
        '<td><span class="{band}">{risk}</span></td><td>{none}'
    ),
    "cve": "<code>{cve}</code> ",
    "close": "</table>",
    "foot": "<p>Made for owners of the code named above. {generated}</p></body></html>",
}
DASH = "—"


def pieces(name: str) -> list[tuple[bool, str]]:
    """A template as (is_column, text) pieces."""
    out = []
    for part in re.split(r"(?<!\{)(\{[a-z_]+\})(?!\})", TEMPLATES[name]):
        if re.fullmatch(r"\{[a-z_]+\}", part):
            out.append((True, part[1:-1]))
        elif part:
            out.append((False, part.replace("{{", "{").replace("}}", "}")))
    return out


def _fill(name: str, /, **columns: Column) -> Column:
    return F.concat(*[columns[text] if is_column else F.lit(text) for is_column, text in pieces(name)])


def _shown(text: Column, wrap: Callable[[Column], Column] = lambda c: c, empty: str = DASH) -> Column:
    """Escaped and wrapped, or ``empty`` for a missing value."""
    present = F.coalesce(text, F.lit("")) != ""
    return F.when(present, wrap(html_escape(text))).otherwise(F.lit(empty))


def _tagged(before: str, after: str) -> Callable[[Column], Column]:
    return lambda c: F.concat(F.lit(before), c, F.lit(after))


def _place() -> Column:
    line = F.when(F.coalesce("line_number", F.lit(0)) != 0, F.concat(F.lit(" :"), F.col("line_number").cast("string")))
    return _shown(F.col("file_path"), lambda c: F.concat(F.lit("<code>"), c, F.lit("</code>"), F.coalesce(line, F.lit(""))))


def _rows(df: DataFrame, part: int, html: Column, k1: Column, k2: Column, k3: Column) -> DataFrame:
    return df.select(
        "scan_id", F.lit(part).alias("part"), F.lit(ROW).alias("kind"), k1.cast("string").alias("k1"),
        k2.cast("long").alias("k2"), k3.cast("string").alias("k3"), html.alias("html"))


def _figures(findings: DataFrame, secrets: DataFrame, packages: DataFrame) -> DataFrame:
    """Head figures and section sizes of every scan, in one aggregation."""
    rows = (
        findings.select("scan_id", F.struct(F.lit(1).alias("finding"), F.lit(0).alias("secret"), F.lit(0).alias("package"),
                                            F.col("severity"), F.lit(0).cast("long").alias("cves")).alias("r"))
        .unionByName(secrets.select("scan_id", F.struct(
            F.lit(0).alias("finding"), F.lit(1).alias("secret"), F.lit(0).alias("package"),
            F.lit(None).cast("string").alias("severity"), F.lit(0).cast("long").alias("cves")).alias("r")))
        .unionByName(packages.select("scan_id", F.struct(
            F.lit(0).alias("finding"), F.lit(0).alias("secret"), F.lit(1).alias("package"),
            F.lit(None).cast("string").alias("severity"), F.col("n_vulns").cast("long").alias("cves")).alias("r")))
    )
    return rows.groupBy("scan_id").agg(
        *[F.count_if(F.col("r.severity") == level).alias(f"{level}_count") for level in ("critical", "high", "medium", "low")],
        F.sum("r.finding").alias("n_findings"), F.sum("r.secret").alias("secrets_count"),
        F.sum("r.package").alias("n_packages"), F.sum("r.cves").alias("dep_vuln_count"))


def report_lines(findings: DataFrame, secrets: DataFrame, packages: DataFrame, generated: str,
                 title: str = "Security Report") -> DataFrame:
    """The lines of every scan's report.

    ``findings`` is a code scan's result, ``secrets`` a secret scan's, and
    ``packages`` comes from ``dependency_findings``.  Each is read more than
    once, for the figures and for the rows, so pass written tables and not the
    scans themselves.  A section is left out when it has no rows.  All texts are
    escaped.
    """
    risk = risk_of_findings(packages)
    none = F.lit("")
    text = lambda c: F.col(c).cast("string")

    def line(part: int, kind: int, html: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), html.alias("html"))
        return made if when is None else F.when(when, made)

    frame = [
        line(HEAD, OPEN, _fill("head", title=html_escape(F.lit(title)), generated=F.lit(generated),
                               scan=html_escape(F.col("scan_id")),
                               **{c: text(c) for c in ("critical_count", "high_count", "medium_count", "low_count",
                                                       "secrets_count", "dep_vuln_count")})),
        line(FOOT, CLOSE, _fill("foot", generated=F.lit(generated))),
    ]
    for part, name, count in ((FINDINGS, "findings", "n_findings"), (SECRETS, "secrets", "secrets_count"),
                              (PACKAGES, "packages", "n_packages")):
        some = F.col(count) > 0
        frame += [line(part, OPEN, _fill(f"{name}_open", n=text(count)), some), line(part, CLOSE, _fill("close"), some)]
    frames = (
        _figures(findings, secrets, risk)
        .select("scan_id", F.explode(F.filter(F.array(*frame), lambda x: x.isNotNull())).alias("x"))
        .select("scan_id", "x.part", "x.kind", none.alias("k1"), F.lit(0).cast("long").alias("k2"), none.alias("k3"), "x.html")
    )
    finding = _fill(
        "finding", color=severity_color(F.col("severity")), severity=F.upper("severity"),
        title=_shown(F.col("title")), description=_shown(F.col("description"), empty=""),
        snippet=_shown(F.col("code_snippet"), _tagged("<pre>", "</pre>"), empty=""),
        fix=_shown(F.col("remediation"), _tagged("<br>Fix: ", ""), empty=""),
        category=_shown(F.col("category")), place=_place(), cwe=_shown(F.col("cwe_id"), _tagged("<code>", "</code>")))
    secret = _fill(
        "secret", color=severity_color(F.col("severity")), severity=F.upper("severity"), type=_shown(F.col("type")),
        masked=_shown(F.col("masked_value")), place=_place())
    package = _fill(
        "package", name=_shown(F.col("name")), version=_shown(F.col("version"), empty=""),
        band=risk_band(F.col("risk_score")), risk=risk_label(F.col("risk_score")),
        none=F.when(F.col("n_vulns") == 0, DASH).otherwise(""))
    named = F.concat_ws(" ", "name", "version")
    cve = F.concat(named, F.lit("\n"), F.col("cve_id"))
    in_file = F.col("rule_order").cast("long") * 1_000_000_000 + F.col("line_number")
    return (
        frames
        .unionByName(_rows(findings, FINDINGS, finding, F.col("file_path"), in_file, none))
        .unionByName(_rows(secrets, SECRETS, secret, F.col("file_path"), F.col("line_number"), F.col("id")))
        .unionByName(_rows(risk, PACKAGES, package, none, F.col("ordinal"), named))
        .unionByName(_rows(packages.where("cve_id is not null"), PACKAGES, _fill("cve", cve=html_escape(F.col("cve_id"))),
                           none, F.col("ordinal"), cve))
    )


def write_reports(lines: DataFrame, path: str) -> None:
    """For few scans (``ranges.write_ranges`` with :data:`ORDER` is for many): one folder ``scan_id=<id>`` per scan; its files in name order are the report.

    Ranges are cut by all sort keys, so one scan's lines may go to many tasks.
    """
    keys = ["scan_id", *ORDER]
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("scan_id", "html").write.mode("overwrite").partitionBy("scan_id").option("lineSep", "\n").text(path)
