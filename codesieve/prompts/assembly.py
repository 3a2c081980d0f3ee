"""Prompts and message lists for language models, as plain text columns.

No model is called here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SYSTEM_PROMPT = (
    "You are a security assistant for software developers. Explain findings precisely, name the matching "
    "CWE and OWASP entries, always give a fix, and assume that all testing is authorized."
)

# The answers given when no model provider is configured.
OFFLINE_REMEDIATION = (
    "AI provider not configured. General remediation guidance:\n\n"
    "## Root Cause\nReview the flagged code pattern for unsafe data handling.\n\n"
    "## Fixed Code\nApply input validation, parameterised queries, and least-privilege principles.\n\n"
    "## Defence in Depth\n- Enable WAF rules\n- Apply CSP headers\n- Enforce code review gates\n\n"
    "## Testing Guidance\nWrite unit tests that inject malicious payloads and verify they are rejected.\n\n"
    "Set OPENAI_API_KEY or ANTHROPIC_API_KEY in .env for AI-powered suggestions."
)
OFFLINE_CHAT_BEFORE = (
    "AI provider not configured. Please set OPENAI_API_KEY or ANTHROPIC_API_KEY in your .env file.\n\n"
    "Your question was: "
)
OFFLINE_CHAT_AFTER = "\n\nFor security questions, refer to: https://owasp.org/www-project-top-ten/"

def _line(label: str, value: Column) -> Column:
    """A labelled line, or null (which the join skips) for a missing value."""
    return F.concat(F.lit(label), F.nullif(value, F.lit("")))


def remediation_prompt(*, title: Column, category: Column, severity: Column, description: Column, cwe: Column,
                       owasp: Column, snippet: Column, context: Column, hint: Column, language: Column) -> Column:
    """Labelled lines about a finding; optional parts only when there is a value."""
    # The labels.
    code_label = F.concat(F.lit("\n**Vulnerable code ("), language, F.lit("):**\n```"), language, F.lit("\n"),
                          F.nullif(snippet, F.lit("")), F.lit("\n```"))
    context_label = F.concat(F.lit("\n**Surrounding context:**\n```"), language, F.lit("\n"),
                             F.nullif(context, F.lit("")), F.lit("\n```"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**Vulnerability:** "), title),
        F.concat(F.lit("**Category:** "), category),
        F.concat(F.lit("**Severity:** "), F.upper(severity)),
        F.concat(F.lit("**Description:** "), description),
        _line("**CWE:** ", cwe),
        _line("**OWASP:** ", owasp),
        code_label,
        context_label,
        _line("\n**Existing hint:** ", hint),
    )


def review_prompt(code: Column, language: Column, context: Column) -> Column:
    # Fixed value: the wording of the request.
    request = F.concat(
        F.lit("Please perform a thorough security code review of the following "), language,
        F.lit(" code. Identify all security vulnerabilities, classify them by OWASP category and CWE ID, "
              "and provide specific remediation for each finding.\n\n```"),
        language, F.lit("\n"), code, F.lit("\n```"))
    extra = F.concat(F.lit("\n\nAdditional context: "), F.nullif(context, F.lit("")))
    return F.concat(request, F.coalesce(extra, F.lit("")))


def affected_text(affected: Column) -> Column:
    """The first five affected packages, or ``unknown``."""
    return F.when(F.size(affected) > 0, F.array_join(F.slice(affected, 1, 5), ", ")).otherwise("unknown")


def cve_prompt(cve_id: Column, summary: Column, severity: Column, cvss: Column, affected: Column,
               include_technical: Column) -> Column:
    # Labels and closing sentences.
    body = F.concat(
        F.lit("CVE ID: "), cve_id,
        F.lit("\nSummary: "), F.coalesce(summary, F.lit("No details available")),
        F.lit("\nSeverity: "), severity, F.lit(" (CVSS: "), F.coalesce(cvss.cast("string"), F.lit("None")),
        F.lit(")\nAffected packages: "), affected_text(affected),
        F.lit("\n\nPlease explain this vulnerability as described in the system prompt."))
    return F.concat(body, F.when(include_technical, "").otherwise(
        "\nFocus on business impact rather than technical details."))


def chat_messages(turns: DataFrame, contexts: DataFrame | None = None,
                  system_prompt: str = DEFAULT_SYSTEM_PROMPT) -> DataFrame:
    """Message rows (conv_id, position, role, content): the system message at 0,
    then the turns in order.

    Kept as rows: a conversation of any length needs no group in one task.
    ``contexts`` (conv_id, context) adds a scan context to the system message.
    """
    ids = turns.select("conv_id").distinct()
    system = F.lit(system_prompt)
    if contexts is not None:
        ids = ids.join(contexts.select("conv_id", "context"), "conv_id", "left")
        added = F.concat(F.lit("\n\n## Scan Context\n"), F.nullif("context", F.lit("")))
        system = F.concat(system, F.coalesce(added, F.lit("")))
    first = ids.select("conv_id", F.lit(0).cast("long").alias("position"), F.lit("system").alias("role"),
                       system.alias("content"))
    rest = turns.select("conv_id", (F.col("turn") + 1).cast("long").alias("position"), "role",
                        F.col("text").alias("content"))
    return first.unionByName(rest)


def split_system(turns: DataFrame) -> DataFrame:
    """Message rows without system turns, plus one row per conversation with its
    first system message (``kind`` system)."""
    is_system = F.col("role") == "system"
    first = turns.where(is_system).groupBy("conv_id").agg(
        F.min("turn").alias("turn"), F.min_by("text", "turn").alias("content"))
    rest = turns.where(~is_system)
    return first.select("conv_id", F.lit("system").alias("kind"), "turn", F.lit("system").alias("role"), "content").unionByName(
        rest.select("conv_id", F.lit("message").alias("kind"), "turn", "role", F.col("text").alias("content")))


def flatten_transcript(turns: DataFrame) -> DataFrame:
    """``role: content`` lines (conv_id, turn, line).

    Lines stay rows and :func:`write_transcripts` joins them with newlines, so a
    conversation of any length is never collected in one task.
    """
    return turns.select("conv_id", "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))


def write_transcripts(lines: DataFrame, path: str) -> None:
    """One folder ``conv_id=<id>`` per conversation; its files in name order are
    the transcript."""
    ordered = lines.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    ordered.select("conv_id", "line").write.mode("overwrite").partitionBy("conv_id").text(path)


def chat_fallback(turns: DataFrame) -> DataFrame:
    """The offline reply to the last message of every conversation."""
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"))
    return last.select("conv_id", F.concat(
        F.lit(OFFLINE_CHAT_BEFORE), F.coalesce("last", F.lit("")), F.lit(OFFLINE_CHAT_AFTER)).alias("reply"))
