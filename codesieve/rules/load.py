"""User rules from a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .model import CodeRule

MAX_RULES = 2_000
COLUMNS = ("rule_id", "pattern", "severity", "title", "category", "description", "remediation", "cwe_id",
           "owasp_category")


def rules_from_table(table: DataFrame, max_rules: int = MAX_RULES) -> tuple[CodeRule, ...]:
    """Rows of a rule table (in ``rule_order``) as rules for ``code_scan``.

    Rules become literals of the plan, as the built-in ones are.  They are
    configuration; a table beyond ``max_rules`` is refused and never cut short.
    Languages count without case, as those of files do.  A pattern that does not compile is
    refused with its rule's id.
    """
    rows = table.orderBy("rule_order").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"more than {max_rules} rules; scan with parts of the table")
    for row in rows:
        try:
            re.compile(row["pattern"])
        except re.error as e:
            raise ValueError(f"rule {row['rule_id']}: pattern does not compile: {e}") from e
    return tuple(
        CodeRule(
            **{c: row[c] for c in COLUMNS if c in row.asDict() and row[c] is not None},
            languages=tuple(x.lower() for x in row["languages"] or ("any",)),
            requires=((tuple(x.lower() for x in row["required_literals"]),) if row["required_literals"] else ()),
        )
        for row in rows
    )
