"""Progress of running scans, as requests and results of steps arrive.

Requests and results are streams of their own, and either may come first.  A small state machine per scan
puts them in order: the start of a step is told when the step before it has ended, the end of a step when its result is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import SCAN_TYPES as STEPS
from .scan_stream import START_MESSAGES

EVENTS = "scan_id string, seq int, step string, phase string, progress int, message string, payload string"
_STATE = "scans string"
_COLUMNS = ("bucket", "scan_id", "ts", "at", "scan_types", "step", "message", "payload")


def step_results(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """(scan_id, step, message, payload) for every step that a request asks for.

    ``findings`` are those of :func:`scan_stream` for a table of requests, such as a micro-batch.  A payload is JSON: the
    findings as ``rule:line``, or the checks passed, failed and in total.  It holds all findings of one request.
    """
    asked = requests.select("scan_id", F.explode(F.array_distinct("scan_types")).alias("step")).where(F.col("step").isin(*STEPS)) \
        .groupBy("scan_id", "step").agg(F.lit(None).cast("string").alias("found"), F.lit(None).cast("int").alias("check"))
    check = F.when(F.col("kind") == "owasp", F.substring_index(F.substring_index("rule_id", ":", 1), "A", -1).try_cast("int"))
    found = findings.select("scan_id", F.col("kind").alias("step"),
                            F.concat(F.lit('"'), "rule_id", F.lit(":"), F.col("line_number").cast("string"), F.lit('"')).alias("found"), check.alias("check"))
    steps = asked.unionByName(found).groupBy("scan_id", "step").agg(
        F.count("found").alias("n"), F.sort_array(F.collect_list("found")).alias("found"),
        F.bit_count(F.bit_or(F.pow(F.lit(2), F.col("check") - 1).cast("int"))).alias("failed"))
    text = lambda c: c.cast("string")
    passed, failed = 10 - F.coalesce("failed", F.lit(0)), F.coalesce("failed", F.lit(0))
    return steps.select(
        "scan_id", "step",
        F.when(F.col("step") == "secrets", F.concat(F.lit("Found "), text(F.col("n")), F.lit(" secret(s)")))
        .when(F.col("step") == "code", F.concat(F.lit("Found "), text(F.col("n")), F.lit(" vulnerability/ies")))
        .otherwise(F.concat(F.lit("OWASP: "), text(passed), F.lit("/10 passed"))).alias("message"),
        F.when(F.col("step") == "owasp", F.concat(F.lit('{"passed":'), text(passed), F.lit(',"failed":'), text(failed), F.lit(',"total":10}')))
        .otherwise(F.concat(F.lit("["), F.array_join("found", ","), F.lit("]"))).alias("payload"))


class Progress:
    """One scan: what it asked for, how many steps have ended, and the results that are there."""

    def __init__(self, scan_id: str, types: list[str] | None = None, ended: int = 0, results: dict[str, list] | None = None, due: int = 0):
        self.scan_id, self.types, self.ended, self.results, self.due = scan_id, types, ended, results or {}, due

    @property
    def fields(self) -> tuple:
        return self.types, self.ended, self.results, self.due

    @property
    def steps(self) -> list[str]:
        return [s for s in STEPS if s in self.types]

    def share(self) -> int:
        return int(self.ended / len(self.types) * 90) + 5

    def event(self, step: str, phase: str, progress: int | None, message: str, payload: str | None = None) -> tuple:
        seq = 2 * len(STEPS) if step == "complete" else 2 * len(STEPS) + 1 if step == "error" else 2 * STEPS.index(step) + (phase == "end")
        return self.scan_id, seq, step, phase, progress, message, payload

    def request(self, types: list[str]) -> Iterator[tuple]:
        """A request opens the scan; one that comes while the scan runs changes nothing."""
        if self.types is None:
            self.types = list(types)
            yield from self.start()

    def start(self) -> Iterator[tuple]:
        if self.ended < len(self.steps):
            step = self.steps[self.ended]
            yield self.event(step, "start", 10 if step == "secrets" else self.share(), START_MESSAGES[step])

    def advance(self) -> Iterator[tuple]:
        """The events that the results at hand allow."""
        while self.types is not None and self.ended < len(self.steps) and self.steps[self.ended] in self.results:
            step = self.steps[self.ended]
            self.ended += 1
            yield self.event(step, "end", 95 if step == "owasp" else self.share(), *self.results[step])
            yield from self.start()
        if self.finished:
            parts = "".join(f',"{s}":{self.results[s][1]}' for s in self.steps)
            yield self.event("complete", "end", 100, "Scan complete", f'{{"scan_id":{json.dumps(self.scan_id)}{parts}}}')

    @property
    def finished(self) -> bool:
        return self.types is not None and self.ended == len(self.steps)


def scan_events(requests: DataFrame, results: DataFrame, watermark: str = "1 hour", patience_ms: int = 24 * 3600 * 1000, buckets: int = 1024) -> DataFrame:
    """The progress events of scans: each once, numbered in their order, with message and payload.

    ``requests`` are streams of (scan_id, ts, scan_types), ``results`` of (scan_id, ts, step, message, payload).  Names of
    steps that are not known count in the total but give no event.  A finished scan is forgotten: a request
    under its id starts anew.  One that waits for a result longer than ``patience_ms`` of event time ends with an error event.
    Rows without a scan_id and results without a step are left out.

    A call of Python costs some milliseconds, so it takes a bucket of scans, by the hash of their ids, with the state of those that still run.  A bucket's
    state is written anew when any of its scans changes: choose ``buckets`` so that some hundred scans run in each; a checkpoint keeps its number.
    """
    none = F.lit(None).cast("string")
    asked = requests.select("scan_id", "ts", F.coalesce("scan_types", F.array().cast("array<string>")).alias("scan_types"),
                            none.alias("step"), none.alias("message"), none.alias("payload"))
    done = results.where("step is not null").select("scan_id", "ts", F.lit(None).cast("array<string>").alias("scan_types"), "step", "message", "payload")

    def run(key, frames, state):
        now = state.getCurrentWatermarkMs()
        scans = {i: Progress(i, *fields) for i, fields in json.loads(state.get[0]).items()} if state.exists else {}
        touched, out = set(), []
        for frame in () if state.hasTimedOut else frames:
            # Results before requests, so that a request finds what is there.
            for scan_id, at, types, step, *told in frame[list(_COLUMNS)].drop(columns=["bucket", "ts"]).sort_values("step", kind="stable").itertuples(index=False, name=None):
                touched.add(scan_id)
                scan = scans.setdefault(scan_id, Progress(scan_id))
                scan.due = max(scan.due, at + patience_ms)
                if types is None:
                    scan.results.setdefault(step, told)
                else:
                    out += scan.request(types)
        for scan_id in touched:
            scan = scans[scan_id]
            out += scan.advance()
            scan.due = max(scan.due, now + 1)
        for scan in scans.values():
            if scan.due < now:
                out.append(scan.event("error", "end", None, "No result in time"))
        scans = {i: s for i, s in scans.items() if s.due >= now and not s.finished}
        if scans:
            state.update((json.dumps({i: s.fields for i, s in scans.items()}),))
            state.setTimeoutTimestamp(max(min(s.due for s in scans.values()), now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"progress": "Int32"})

    rows = asked.unionByName(done).where("scan_id is not null").withWatermark("ts", watermark) \
        .withColumns({"bucket": F.pmod(F.xxhash64("scan_id"), F.lit(buckets)), "at": F.coalesce(F.unix_millis("ts"), F.lit(0))}).select(*_COLUMNS)
    return rows.groupBy("bucket").applyInPandasWithState(run, EVENTS, _STATE, "append", "EventTimeTimeout")
