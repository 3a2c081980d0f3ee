"""Spelling variants: words of a vocabulary that differ by one inserted, deleted or replaced code point.

Search schemes on a bidirectional FM-index over the delimited vocabulary.  A word is cut in halves.  One of them
lies without error in any word that is one error away, so one search matches the left half exactly, from its inner end out to the
delimiter before it, and goes on to the right with one error, and another does the same mirrored.  Both work on
suffix-rank intervals of the text and of its mirror image, kept in step; ranks come from wavelet matrices.
The second search leaves out what begins with the left half, which the first has found.

The index is cut into tiles: a word that begins with a left half begins with its first two code points, so the first search needs
only the words of such a beginning, the second those of an ending.  Rare beginnings share a tile, common ones are
dealt to several, words and searches alike, so that a tile's index and its searches stay bounded.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.session import written

from .common import groups, texts

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
TILE_CHARS = 250_000  # characters of the words of one index, about
COUNTED = 150_000  # different words that a task counts before it passes them on
SEARCHED = 4_000  # words (or one) that are searched for together
SEARCHED_CHARS = 60_000


# ---- the vocabulary

def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, slip: int = 97) -> DataFrame:
    """(word, n): the maximal runs of letters of whole texts, A-Z lower-cased, that have ``least_chars`` code points and occur ``least_n`` times.

    Let h be the crc32 of ``<doc_id>:<run>``.  Where ``slip`` divides h, the run's code point h % length is deleted
    first (never, if ``slip`` is 0).  Null texts have no words; a null id is written as an empty one.  Repeated rows count each.
    """
    at_least = re.compile(LETTERS.pattern[:-1] + "{%d,}" % least_chars)  # shorter runs don't get longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in groups(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                runs = Counter(at_least.findall(text.encode().lower().decode()))  # bytes lower-case A-Z only
                if slip:
                    key = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word in [w for w in runs if zlib.crc32(w.encode(), key) % slip == 0]:
                        at, n = zlib.crc32(word.encode(), key) % len(word), runs.pop(word)
                        if len(word) > least_chars:
                            counts[word[:at] + word[at + 1:]] += n
                counts.update(runs)
            if len(counts) > COUNTED:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    return (texts(df, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_n))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


# ---- the index

def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; the last symbol, 0, occurs once."""
    n, bits = len(text), max(1, int(text.max()).bit_length())
    rank, step = text.astype(np.int64), 1
    while step * 2 * bits <= 62:  # as many symbols at once as a number holds
        rank = (rank << (step * bits)) | np.concatenate((rank[step:], np.zeros(min(step, n), np.int64)))[:n]
        step *= 2
    while True:
        order = np.argsort(rank, kind="stable")
        first = np.empty(n, bool)
        first[0], first[1:] = False, rank[order[1:]] != rank[order[:-1]]
        place = np.cumsum(first)
        if place[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = place
        after = np.zeros(n, np.int64)
        after[:max(n - step, 0)] = rank[step:] + 1
        rank, step = rank * (n + 1) + after, step * 2


class Index:
    """FM-index of one text: suffix array, Burrows-Wheeler transform, and its wavelet matrix for ranks."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.suffixes = suffix_array(text)
        self.bwt = text[self.suffixes - 1].astype(np.int32)
        self.bits = max(1, int(symbols - 1).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:symbols]
        self.zeros, rest = [], self.bwt
        for level in reversed(range(self.bits)):
            one = (rest >> level & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))).astype(np.int32))
            rest = np.concatenate((rest[~one], rest[one]))
        self.base = self.walk(np.arange(symbols), np.zeros(symbols, np.int64), np.zeros(symbols, np.int64))[0]

    def walk(self, symbol, low, high):
        """Places of the ends low and high among the equal symbols of the last level, and how many smaller symbols lie between."""
        less = np.zeros(len(symbol), np.int64)
        for level, zeros in zip(reversed(range(self.bits)), self.zeros):
            one = (symbol >> level & 1).astype(bool)
            a, b = zeros[low], zeros[high]
            less += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return low, high, less

    def extend(self, symbol, low, other, size):
        """Intervals after putting a symbol before the pattern: here, in the mirrored index, and their size."""
        start, end, less = self.walk(symbol, low, low + size)
        return self.before[symbol] + start - self.base[symbol], other + less, end - start


DELIMITER, FIRST = 1, 2  # 0 ends the text; letters follow


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words in a row, and their lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


class Vocabulary:
    """Both indexes over ``|word|word|...|``; ``mirror`` is that of the text read backwards.  Words are distinct."""

    def __init__(self, words: list[str]):
        points, lengths = flat(words)
        self.words, self.alphabet = pa.array(words, pa.string()), np.unique(points)
        self.place = {w: i for i, w in enumerate(words)}
        self.symbols = len(self.alphabet) + FIRST
        text = np.full(len(points) + len(words) + 1, DELIMITER, np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        text[np.arange(len(points)) + np.repeat(np.arange(len(words)) + 1, lengths)] = np.searchsorted(self.alphabet, points) + FIRST
        self.ahead, self.mirror = (Index(np.append(t, 0), self.symbols) for t in (text, text[::-1]))
        self.starts, self.size = starts - 1, len(text)

    def symbols_of(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points, -1 for those that no word has."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + FIRST, -1)

    def near(self, queries: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word), as places in their lists, where the word is one error away in the half that is not matched
        exactly: the right one, or mirrored the left one.  Every pair once."""
        points, lengths = flat(queries)
        begin = np.cumsum(lengths) - lengths
        half = lengths // 2
        symbols = self.symbols_of(points)
        if mirrored:  # the words read backwards, the halves and the indexes exchanged
            symbols, begin, half = symbols[::-1], len(symbols) - begin - lengths, lengths - half
        left, right = (self.mirror, self.ahead) if mirrored else (self.ahead, self.mirror)

        # The exact half, from its inner end to the delimiter.
        q = np.arange(len(queries))
        low, other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.size + 1)
        done = []
        for step in range(int(half.max(initial=0)) + 1):
            c = np.where(step < half[q], symbols[begin[q] + np.maximum(half[q] - 1 - step, 0)], DELIMITER)
            known = c >= 0
            q, c = q[known], c[known]
            low, other, size = left.extend(c, low[known], other[known], size[known])
            closed, open_ = (c == DELIMITER) & (size > 0), (c != DELIMITER) & (size > 0)
            if closed.any():
                done.append((q[closed], low[closed], other[closed], size[closed]))
            q, low, other, size = q[open_], low[open_], other[open_], size[open_]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, low, other, size = (np.concatenate(c) for c in zip(*done))
        j, wrong = half[q].copy(), np.zeros(len(q), bool)
        own = np.fromiter((w in self.place for w in queries), bool, len(queries))

        found, steps = [], 0
        while len(q):
            steps += 1
            if steps % 16 == 0:  # in long words many ways may lead to one state
                order = np.lexsort((size, low, wrong, j, q))
                same = np.all([c[order[1:]] == c[order[:-1]] for c in (q, j, wrong, low, size)], axis=0)
                first = np.sort(order[np.append(True, ~same)])
                q, low, other, size, j, wrong = (c[first] for c in (q, low, other, size, j, wrong))
            inside = j < lengths[q]
            c = np.where(inside, symbols[begin[q] + np.minimum(j, lengths[q] - 1)], DELIMITER)
            # States without an error yet: every next letter as an inserted or replaced one, or this one left out.
            free = np.flatnonzero(~wrong & ~((size == 1) & own[q]))
            s, letter = self.letters(right, other[free], size[free])
            s = free[s]
            o2, l2, n2 = right.extend(letter, other[s], low[s], size[s])
            replaced = np.flatnonzero(inside[s] & (letter != c[s]))
            skipped = free[inside[free]]
            # The next symbol itself: the delimiter ends the word.
            on = np.flatnonzero((c >= 0) & (wrong | (inside & ~((size == 1) & own[q]))))
            o1, l1, n1 = right.extend(c[on], other[on], low[on], size[on])
            ended = (c[on] == DELIMITER) & (n1 > 0)
            found.append((q[on[ended]], l1[ended]))
            ok = ~ended & (n1 > 0)
            on, o1, l1, n1 = on[ok], o1[ok], l1[ok], n1[ok]
            state = [(q[on], l1, o1, n1, j[on] + 1, wrong[on]), (q[s], l2, o2, n2, j[s], np.ones(len(s), bool)),
                     (q[s[replaced]], l2[replaced], o2[replaced], n2[replaced], j[s[replaced]] + 1, np.ones(len(replaced), bool)),
                     (q[skipped], low[skipped], other[skipped], size[skipped], j[skipped] + 1, np.ones(len(skipped), bool))]
            q, low, other, size, j, wrong = (np.concatenate(c) for c in zip(*state))
        q, low = (np.concatenate(c) for c in zip(*found)) if found else (q, low)
        at = left.suffixes[low]
        # The match starts at the delimiter before its word, mirrored at the one behind it.
        word = np.searchsorted(self.starts, self.size - 1 - at if mirrored else at, side="left" if mirrored else "right") - 1
        pairs = np.unique(q * len(self.words) + word)
        return pairs // len(self.words), pairs % len(self.words)

    def letters(self, right: Index, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) for the letters that follow in each interval, or all letters where it is longer than the alphabet."""
        letters = self.symbols - FIRST
        few = size <= letters
        reps = np.where(few, size, letters)
        state = np.repeat(np.arange(len(size)), reps)
        offset = np.arange(len(state)) - np.repeat(np.cumsum(reps) - reps, reps)
        letter = np.where(few[state], right.bwt[np.where(few[state], other[state] + offset, 0)], FIRST + offset)
        keys = np.unique((state * self.symbols + letter)[letter >= FIRST])
        return keys // self.symbols, keys % self.symbols


# ---- the join

TILE = ["side", "bucket", "part", "block"]


def tiles(words: DataFrame, tile_chars: int = TILE_CHARS) -> DataFrame:
    """Rows (side, bucket, part, block, searched, word, n): the words of each tile's index and, after them, the searches to run on it.

    The part of a common beginning or ending is dealt by hashes of the words, once as indexed ones and once as searches.
    """
    sides = words.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))) \
        .withColumn("pair", F.when(F.col("side") == 0, F.substring("word", 1, 2)).otherwise(F.substring("word", -2, 2)))
    chars = sides.groupBy("side", "pair").agg(F.sum(F.length("word") + 1).alias("chars"))
    total = int(words.agg(F.sum(F.length("word") + 1)).first()[0] or 0)
    buckets = max(1, -(-total // tile_chars))
    # At most total / tile_chars beginnings, and as many endings, are common.
    common = chars.where(F.col("chars") > tile_chars).select("side", "pair", F.ceil(F.col("chars") / tile_chars).alias("parts"))
    rows = sides.join(common, ["side", "pair"], "left")
    hashed = F.xxhash64("pair")
    rows = rows.withColumn("bucket", F.when(F.col("parts").isNull(), F.pmod(hashed, F.lit(buckets))).otherwise(buckets + F.pmod(hashed, F.lit(1 << 40)))) \
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    indexed = rows.withColumn("part", F.pmod(F.xxhash64("word"), "parts")).withColumn("block", every).withColumn("searched", F.lit(False))
    searches = rows.withColumn("block", F.pmod(F.xxhash64("word", F.lit(1)), "parts")).withColumn("part", every).withColumn("searched", F.lit(True))
    columns = [*TILE, "searched", "word", "n"]
    return indexed.select(*columns).unionByName(searches.select(*columns)).repartition(4 * buckets, *TILE).sortWithinPartitions(*TILE, "searched", "word")


def near_pairs(words: DataFrame, tile_chars: int = TILE_CHARS) -> DataFrame:
    """(word, near, near_n) for all words exactly one inserted, deleted or replaced code point apart, both ways, each once.

    ``words`` are distinct (word, n) with words of at least four code points, so that no half is shorter than the two
    by which tiles are dealt; shorter, null and empty words are near to none here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, index, listed, counts = None, None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*TILE, "searched"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                *key, searched = keys[start]
                if key != tile:
                    tile, index, listed, counts = key, None, [], []
                rows = batch.slice(start, stop - start)
                if not searched:
                    listed += rows.column("word").to_pylist()
                    counts += rows.column("n").to_pylist()
                    continue
                if not listed:
                    continue
                index = index or Vocabulary(listed)
                for part in groups(iter([rows]), "word", SEARCHED_CHARS):
                    for i in range(0, part.num_rows, SEARCHED):
                        words_of = part.column("word").slice(i, SEARCHED)
                        asked = words_of.to_pylist()
                        q, w = index.near(asked, mirrored=key[0] == 1)
                        if key[0] == 1:  # what begins with the left half was found by the other search
                            new = [not listed[b].startswith(asked[a][:len(asked[a]) // 2]) for a, b in zip(q.tolist(), w.tolist())]
                            q, w = q[new], w[new]
                        yield pa.record_batch([words_of.take(pa.array(q)), index.words.take(pa.array(w)), pa.array(np.array(counts, np.int64)[w])],
                                              names=["word", "near", "near_n"])

    return tiles(words.where(F.length("word") >= 4), tile_chars).mapInArrow(run, "word string, near string, near_n long")


def followed(links: DataFrame, purpose: str = "forms") -> DataFrame:
    """(word, root): the last word that ``links`` (word, form), free of circles, lead to.  Every round doubles the way that is followed."""
    at = written(links.select("word", F.col("form").alias("root")), purpose)
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), purpose)
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, factor: int = 2, tile_chars: int = TILE_CHARS) -> DataFrame:
    """A row per word of the distinct (word, n): word, form, root, n, n_near, form_n.

    ``n_near`` counts the near words.  ``form`` is the near word of largest n (the first of equals in code-point
    order) if that n is at least ``factor`` times the word's, which has to be more than 1; else null.  ``root`` is where forms lead in the end.
    """
    words = written(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, tile_chars).groupBy("word").agg(F.count("*").alias("n_near"), best)
    form = F.when(-F.col("best.n") >= factor * F.col("n"), F.col("best.near"))
    found = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.n")).alias("form_n")), "near-words")
    roots = followed(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
