"""Language identification with interpolated Kneser-Ney character models.

Every language has a model of character n-grams with absolute discounts; lower orders are built from the numbers of
different characters that precede an n-gram.  The models of all languages are one sorted array of n-gram
hashes for each order, with a row of log-probabilities (one for each language) beside each hash.  The language with
the lowest cross-entropy per character wins; a text that fits even this one worse than nearly all texts of
known language do is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import written

from .common import groups

ORDER = 4
UNKNOWN = "und"
TRAIN = "lang string, k int, gram long, n long"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

# Whatever is not a letter is one space.  A text's letters are what str.isalpha() calls letters.
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased words of a text, each with a space before and after it; empty without letters."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not words or not any(map(str.isalpha, words[:64])) and not any(map(str.isalpha, words)):
        return np.empty(0, np.uint64)
    return np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """63-bit hashes of the n-grams of a length (the last character included), one for each position that has one."""
    n = max(0, len(codes) - order + 1)
    out = np.full(n, order, np.uint64)
    for i in range(order):
        out = (out ^ codes[i:i + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    return ((out * _MIX[1]) >> np.uint64(1)).astype(np.int64)


class Counts:
    """Counts of one language: for each order the gram's hash, its context's, its suffix's, and how often it occurs."""

    def __init__(self, words: list[tuple[str, int]]):
        self.orders = []
        # all words in a row, each with a space before and after it, a zero between them
        line = "\0".join(f" {w} " for w, _ in words)
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        cuts = np.concatenate(([0], np.cumsum(codes == 0)))
        times = np.repeat(np.array([n for _, n in words], np.float64), np.diff(np.concatenate(([-1], np.flatnonzero(codes == 0), [len(codes)]))))[:len(codes)]
        for k in range(1, ORDER + 1):
            n = max(0, len(codes) - k + 1)
            inside = np.flatnonzero(cuts[k:k + n] == cuts[:n])  # n-grams within one word
            grams, below = gram_hashes(codes, k), gram_hashes(codes, k - 1)
            context, suffix = below[inside], below[inside + 1] if k > 1 else np.zeros(len(inside), np.int64)
            key, first, back = np.unique(grams[inside], return_index=True, return_inverse=True)
            self.orders.append((key, context[first], suffix[first], np.bincount(back, times[inside], len(key))))


class Sorted:
    """A sorted array of hashes.  The leading bits of a hash tell where to start; from there few steps lead to its place."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(4 * len(keys)).bit_length())
        self.shift = 63 - bits
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.int64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.iinfo(np.int64).max)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether the hash is there)."""
        at = self.first[hashes >> self.shift]
        while (below := self.keys[at] < hashes).any():
            at += below
        return at, self.keys[at] == hashes


class Models:
    """The models of all languages.

    ``counts`` has for each language its words with their numbers.  probability(order, gram) is interpolated with the
    next lower order; an n-gram that no language has seen takes its context's share of the lower order.  The discount of
    an order is n1 / (n1 + 2 n2) of its counts, or ``usual`` where one of them is missing.
    """

    def __init__(self, words: dict[str, list[tuple[str, int]]], usual: float = 0.75):
        self.langs = sorted(words)
        sets = {lang: Counts(words[lang]) for lang in self.langs}
        self.keys, self.found, self.logs, self.contexts, self.backoff = [], [], [], [], []
        alphabet = max(2, len(np.unique(np.concatenate([sets[x].orders[0][0] for x in self.langs] or [np.zeros(1)]))))
        self.floor = -math.log(alphabet + 1)
        for k in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([sets[x].orders[k - 1][0] for x in self.langs] or [np.empty(0, np.int64)]))
            contexts = np.unique(np.concatenate([sets[x].orders[k - 1][1] for x in self.langs] or [np.empty(0, np.int64)]))
            logs, backoff = np.zeros((len(keys), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            parent, below = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for x in self.langs:
                key, context, suffix, _ = sets[x].orders[k - 1]
                at = np.searchsorted(keys, key)
                parent[at], below[at] = context, suffix
            for i, x in enumerate(self.langs):
                key, context, _, raw = sets[x].orders[k - 1]
                n = raw
                if k < ORDER:  # how many different characters precede it
                    longer = sets[x].orders[k][2]
                    n = np.bincount(np.searchsorted(key, longer[np.isin(longer, key)]), minlength=len(key)).astype(float)
                    # What begins with the space before a word has no predecessor and keeps its number.
                    n = np.where(n > 0, n, raw)
                once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
                discount = once / (once + 2 * twice) if once and twice else usual
                where = np.searchsorted(contexts, context)
                total = np.bincount(where, n, len(contexts))
                kinds = np.bincount(where, minlength=len(contexts))
                lam = np.where(total > 0, discount * kinds / np.maximum(total, 1e-12), 1.0)
                backoff[:, i] = np.log(np.minimum(lam, 1.0))
                seen = np.zeros(len(keys))
                seen[np.searchsorted(keys, key)] = np.maximum(n - discount, 0.0)
                c = np.searchsorted(contexts, parent)
                lower = self._lower(k, below)[:, i]
                logs[:, i] = np.log(seen / np.maximum(total[c], 1e-12) * (total[c] > 0) + lam[c] * np.exp(lower) + 1e-300)
            self.keys.append(keys)
            self.found.append(Sorted(keys))
            self.logs.append(logs.T.copy())
            self.contexts.append(Sorted(contexts))
            self.backoff.append(backoff.T.copy())

    def _lower(self, k: int, suffix: np.ndarray) -> np.ndarray:
        if k == 1:
            return np.full((len(suffix), len(self.langs)), self.floor)
        # A suffix of an n-gram that was seen was seen itself.
        return self.logs[k - 2][:, np.minimum(np.searchsorted(self.keys[k - 2], suffix), len(self.keys[k - 2]) - 1)].T

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each text under each language; nan for a text without letters."""
        rows = [symbols(t) for t in texts]
        out = np.full((len(rows), max(1, len(self.langs))), np.nan)
        some = [i for i, r in enumerate(rows) if len(r)]
        if not some or not self.langs:
            return out
        size = np.array([len(rows[i]) for i in some])
        codes, doc = np.concatenate([rows[i] for i in some]), np.repeat(np.arange(len(some)), size)
        place = np.arange(len(codes))
        # Contexts begin with the space before a word, as they did in training; the space that starts a text is only context.
        space = np.maximum.accumulate(np.where(codes == 32, place, 0))
        reach = np.minimum(ORDER, place - np.concatenate(([0], space[:-1])) + 1)
        reach[np.cumsum(size) - size] = 0
        total = np.zeros((len(some), len(self.langs)))
        missed = np.empty(0, np.int64)
        for k in range(ORDER, 0, -1):
            ends = np.concatenate((missed, np.flatnonzero(reach == k)))  # the last characters of the n-grams
            at, hit = self.found[k - 1].find(gram_hashes(codes, k)[ends - (k - 1)])
            self._add(total, doc[ends[hit]], self.logs[k - 1], at[hit])
            missed = ends[~hit]
            if len(missed):  # unseen in every language: the context's share of the lower order
                at, known = self.contexts[k - 1].find(gram_hashes(codes, k - 1)[missed - (k - 1)])
                self._add(total, doc[missed[known]], self.backoff[k - 1], at[known])
        total += self.floor * np.bincount(doc[missed], minlength=len(some))[:, None]
        out[some] = -total / (size - 1)[:, None]
        return out

    @staticmethod
    def _add(total: np.ndarray, doc: np.ndarray, logs: np.ndarray, at: np.ndarray) -> None:
        for i in range(total.shape[1]):
            total[:, i] += np.bincount(doc, logs[i][at], len(total))


def trained_on(lang: Column, fold: Column | None) -> Column:
    return lang.isNotNull() if fold is None else lang.isNotNull() & fold


def train(df: DataFrame, rows_per_lang: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          fold: Column | None = None, words_per_lang: int = 50_000, rejected: float = 0.001,
          words_in_all: int = 5_000_000) -> tuple[Models, float]:
    """The models, and the cross-entropy above which a text is rejected, from rows with a non-null language (and in ``fold``).

    The classifier is fitted on a bounded sample of labelled rows: about ``rows_per_lang`` of each language, those with the
    least hashes of id and text, whole texts; of their words (of up to 64 characters) the ``words_per_lang`` most frequent of each
    language, or fewer if all languages together had over ``words_in_all``.  So the models have a bounded size and are
    broadcast.  Half as many other rows, also by hash, calibrate the rejection: the threshold leaves out a share of ``rejected`` of them, and
    lies at least a tenth above the highest of the rest.
    """
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), trained_on(F.col(lang_col), fold).alias("use")) \
        .where("use and text is not null")
    sizes = {r["lang"]: r["count"] for r in df.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not sizes:
        return Models({}), math.inf
    unit = 1_000_000
    part = F.pmod(F.xxhash64("id", "text"), F.lit(unit))
    share = F.create_map(*(F.lit(v) for lang, n in sizes.items() for v in (lang, max(1, math.ceil(unit * min(1.0, 1.5 * rows_per_lang / n))))))[F.col("lang")]
    sample = df.withColumns({"at": part, "share": share}).where("at < share").withColumn("learn", F.col("at") * 3 < F.col("share") * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            langs, words, times = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = _NOT_LETTERS.sub(" ", text.lower()).split()
                langs += [lang] * len(found)
                words += found
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.string())], names=["lang", "word"])

    counted = (sample.where("learn").select("lang", "text").mapInArrow(run, "lang string, word string")
               .where(F.length("word") <= 64).groupBy("lang", "word").count())
    counted = written(counted, "language-words")
    most = max(1, min(words_per_lang, words_in_all // len(sizes)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    words: dict[str, list[tuple[str, int]]] = {}
    for lang, word, n in counted.withColumn("place", place).where(F.col("place") <= most).orderBy("lang", "place").select("lang", "word", "count").toPandas().itertuples(index=False):
        words.setdefault(lang, []).append((word, n))
    models = Models({x: w for x, w in words.items() if w})
    fits = scores(sample.where("not learn").select("id", "text"), models, "id").where("entropy is not null")
    high = fits.agg(F.expr(f"percentile_approx(entropy, {1 - rejected}, 10000)")).first()[0]
    return models, math.inf if high is None else 1.1 * high


def scores(df: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, entropy of every whole text.

    lang_pred is ``und`` for null texts and those without a letter, with score 0 and a null entropy (so it is for all texts
    if there is no model).  The score is the winner's share of the likelihoods of 50 characters.  Ties go to the first language by name.
    One row per input row; no shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            rows = []
            for bits in sent.value.cross_entropies([t or "" for t in batch.column("text").to_pylist()]):
                if np.isnan(bits[0]):
                    rows.append((UNKNOWN, 0.0, None))
                else:
                    best = int(bits.argmin())
                    rows.append((sent.value.langs[best], float(1 / np.exp(-50 * (bits - bits[best])).sum()), float(bits[best])))
            lang, score, entropy = zip(*rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64())],
                                  names=["doc_id", "lang_pred", "score", "entropy"])

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double"))


def accepted(df: DataFrame, models: Models, limit: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose whole text has letters and a cross-entropy of at most ``limit`` under its best language."""
    sent = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, text_col):
            bits = sent.value.cross_entropies([t or "" for t in batch.column(text_col).to_pylist()]).min(axis=1)
            yield batch.filter(pa.array(bits <= limit))  # nan is never below

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
