"""Fixed schemas of the tables and JSON documents the library reads."""

from __future__ import annotations

FILES = "scan_id STRING, file_path STRING, language STRING, code STRING"
SCAN_REQUESTS = "scan_id STRING, ts TIMESTAMP, file_path STRING, language STRING, code STRING, scan_types ARRAY<STRING>"
DEPENDENCIES = "scan_id STRING, ordinal INT, name STRING, version STRING, ecosystem STRING"

_SPECIFIC = "STRUCT<severity: VARIANT, cvss_score: VARIANT>"
ADVISORY = (
    "id STRING, aliases ARRAY<STRING>, summary STRING, published STRING, modified STRING, "
    "severity ARRAY<STRUCT<type: STRING, score: STRING>>, "
    f"database_specific {_SPECIFIC}, "
    "affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>, versions: ARRAY<STRING>, "
    "ranges: ARRAY<STRUCT<type: STRING, events: ARRAY<STRUCT<introduced: STRING, fixed: STRING, "
    f"last_affected: STRING>>>>, database_specific: {_SPECIFIC}>>, "
    "references ARRAY<STRUCT<type: STRING, url: STRING>>"
)
NVD = (
    "vulnerabilities ARRAY<STRUCT<cve: STRUCT<id: STRING, published: STRING, lastModified: STRING, "
    "descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>>>>"
)
