"""URL filters: host and path rules, and a character language-model ratio for what no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs, are learned from the URLs that rules decide.
A URL's score is the difference of its log-likelihoods under the two, divided by its length; the
threshold is calibrated on labelled URLs that the models have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of the models: these, one sign for all others, and one for the start of a URL.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789/.-_%~+:@,"
OTHER, START, SIZE = len(ALPHABET), len(ALPHABET) + 1, len(ALPHABET) + 2
ORDER = 3  # characters of context at most; there are at most SIZE ** (ORDER + 1) contexts and next characters

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What follows the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty for null or without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def decide(host_: Column, path_: Column, rules: list[Rule], what) -> Column:
    """``what`` of the longest rule that fits, null if none does.  Of equally long ones a blocking rule goes first.

    A rule fits its host and all subdomains of it, if the path starts with the rule's.  The rules are a parameter, a short list.
    """
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def codes(text: str) -> np.ndarray:
    """Symbols of a URL's host and path in lower case, after ORDER start signs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return np.concatenate((np.full(ORDER, START), _TABLE[np.minimum(points, 255)]))


_TABLE = np.full(256, OTHER)
_TABLE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """For every character its number together with the ``order`` before it."""
    n = len(symbols) - ORDER
    out = np.zeros(n, np.int64)
    for back in range(order, -1, -1):
        out = out * SIZE + symbols[ORDER - back:ORDER - back + n]
    return out


class Model:
    """Witten-Bell smoothed model of all orders up to ORDER, from counts by (order, gram)."""

    def __init__(self, counts: list[tuple[int, int, int]]):
        self.keys, self.count, self.seen, self.total, self.kinds = [], [], [], [], []
        for k in range(ORDER + 1):
            rows = sorted((g, n) for order, g, n in counts if order == k)
            keys = np.array([g for g, _ in rows], np.int64)
            n = np.array([n for _, n in rows], np.float64)
            context, first, kinds = np.unique(keys // SIZE, return_index=True, return_counts=True)
            self.keys.append(keys)
            self.count.append(n)
            self.seen.append(context)
            self.total.append(np.add.reduceat(n, first) if len(n) else n)
            self.kinds.append(kinds)

    def logs(self, symbols: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the characters."""
        p = np.full(len(symbols) - ORDER, 1 / SIZE)
        for k in range(ORDER + 1):
            if not len(self.keys[k]):
                continue
            g = grams(symbols, k)
            at = np.minimum(np.searchsorted(self.keys[k], g), len(self.keys[k]) - 1)
            n = np.where(self.keys[k][at] == g, self.count[k][at], 0.0)
            c = np.minimum(np.searchsorted(self.seen[k], g // SIZE), len(self.seen[k]) - 1)
            known = self.seen[k][c] == g // SIZE
            kinds, total = self.kinds[k][c], self.total[k][c]
            p = np.where(known, (n + kinds * p) / (total + kinds), p)
        return np.log(p)


def _features(pages: DataFrame, id_col: str, url_col: str, rules: list[Rule]) -> DataFrame:
    url = F.col(url_col)
    at = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    return at.withColumns({"rule": decide(F.col("host"), F.col("path"), rules, lambda r: r.name),
                           "ruled": decide(F.col("host"), F.col("path"), rules, lambda r: r.verdict)})


def learn(labelled: DataFrame) -> dict[str, Model]:
    """Models of the texts of ``labelled`` (text, ruled), one for each verdict, from the counts of all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], []]
            for verdict in ("allow", "block"):
                own = [codes(t) for t, r in zip(batch.column("text").to_pylist(), batch.column("ruled").to_pylist()) if r == verdict]
                for k in range(ORDER + 1) if own else ():
                    g, n = np.unique(np.concatenate([grams(s, k) for s in own]), return_counts=True)
                    for col, values in zip(rows, ([verdict] * len(g), [k] * len(g), g.tolist(), n.tolist())):
                        col += values
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                                  names=["ruled", "k", "gram", "n"])

    counts = labelled.mapInArrow(run, "ruled string, k int, gram long, n long").groupBy("ruled", "k", "gram").agg(F.sum("n").alias("n"))
    # Bounded by the alphabet: at most 2 * SIZE ** (ORDER + 1) rows however many URLs there are.
    rows = counts.toPandas()
    return {v: Model(list(rows[rows.ruled == v][["k", "gram", "n"]].itertuples(index=False, name=None))) for v in ("allow", "block")}


def score(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """``rows`` (page_id, host, path, rule, ruled) with ``ratio``, the length-normalised log-likelihood difference; 0 for an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [codes(h + p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            ratio = [float((sent.value["allow"].logs(s) - sent.value["block"].logs(s)).mean()) if len(s) > ORDER else 0.0 for s in at]
            yield batch.append_column("ratio", pa.array(ratio, pa.float64()))

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", ratio double")


def threshold(scored: DataFrame, bins: int = 400, limit: float = 4.0) -> float:
    """The ratio from which on a URL is allowed: where the mean of the error rates of the two verdicts is least.

    From counts in a fixed number of bins; the middle of equally good cuts, 0 without labelled rows of both verdicts.
    """
    at = F.floor((F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("ratio"))) + limit) * (bins / (2 * limit)))
    n = {"allow": np.zeros(bins + 2), "block": np.zeros(bins + 2)}
    for r in scored.where("ruled is not null").groupBy("ruled", at.alias("bin")).count().collect():
        n[r["ruled"]][r["bin"] + 1] += r["count"]
    if not n["allow"].sum() or not n["block"].sum():
        return 0.0
    wrong = np.cumsum(n["allow"]) / n["allow"].sum() + 1 - np.cumsum(n["block"]) / n["block"].sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(best[len(best) // 2] / bins * 2 * limit - limit)


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", unit: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every URL: the verdict is the rule's, else the models'.

    The models learn from all URLs that a rule decides but for a fifth (by the hash of host and path), on which the
    threshold is calibrated.  Null URLs and those without ``://`` have an empty host and path; what has an empty text, and
    everything when no rule decides any URL, is allowed by the models (ratio 0, threshold at most 0).  Equal
    URLs get equal verdicts; null page_ids and other columns are harmless.
    """
    rows = _features(pages, id_col, url_col, rules)
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    labelled = rows.where("ruled is not null")
    models = learn(labelled.where(~fold).select(F.concat("host", "path").alias("text"), "ruled"))
    cut = threshold(score(labelled.where(fold), models))
    method = F.when((F.col("ratio") >= cut) | ((F.col("host") == "") & (F.col("path") == "")), "allow").otherwise("block")
    return score(rows, models).select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "ratio")


def cross_entropy(model: Model, text: str) -> float:
    """Nats per character of one text, for inspection."""
    logs = model.logs(codes(text))
    return float(-logs.mean()) if len(logs) else math.nan
