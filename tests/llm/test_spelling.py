"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codesieve.llm import spelling
from codesieve.llm.queries import QUERIES
from codesieve.llm.spelling import Index, Vocabulary, near_pairs, suffix_array, variants, word_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n long, side int, part long"  # with clashing names
LOWER = {c: c + 32 for c in range(65, 91)}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, slip=97):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % slip == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    # Near words share all but one letter: look them up by their shortened forms, then test.
    by = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by.setdefault(key, set()).add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_apart(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], DOCS)


def words_table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("letters,longest,tile", [("ab", 9, 60), ("abcdé", 7, 400), ("abcdefghij", 6, 10 ** 6), ("aÿ×", 8, 25)])
def test_random_vocabularies(spark, letters, longest, tile):
    rng = random.Random(longest)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))): rng.randint(1, 40) for _ in range(600)}
    assert rows_of(variants(words_table(spark, words), tile_chars=tile)) == brute_variants(words)


def test_one_beginning_for_all_words(spark):
    rng = random.Random(3)
    words = {"abcd" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + "xy": rng.randint(3, 99) for _ in range(400)}
    got = near_pairs(words_table(spark, words), tile_chars=300).collect()
    assert len({(r.word, r.near) for r in got}) == len(got)
    assert rows_of(variants(words_table(spark, words), tile_chars=300)) == brute_variants(words)


def test_very_long_words(spark):
    base = "ab" * 4000 + "c" * 2000
    words = {base: 9, base[:5000] + base[5001:]: 3, base + "x": 4, "y" + base: 2, base[:-1] + "d": 1, "a" * 9000: 5, "a" * 9001: 20, "short": 3}
    assert rows_of(variants(words_table(spark, words))) == brute_variants(words)


def test_words_of_texts(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(3, 8))) for _ in range(40)]
    texts = [None, "", "1234 __ ..", "a" * 2_000, "ÀÉÎ àéî ÀÉÎÕÜ àéîõü", "x×y÷z x×y÷z x×y÷z", "Ünïcode ünïcode ÜNÏCODE"]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.3 else w for w in rng.choices(stems, k=300)) + "\n" + (rng.choice(texts) or "")) for i in range(60)]
    rows += [(None, texts[3]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (-9, texts[4])] + [(100 + i, t) for i, t in enumerate(texts)]
    df = table(spark, rows).repartition(4)
    for slip in (97, 3):
        words = brute_words(rows, slip)
        assert {r.word: r.n for r in word_counts(df, slip=slip).collect()} == words
    assert rows_of(variants(word_counts(df, slip=3))) == brute_variants(brute_words(rows, 3))


def test_nothing_to_do(spark):
    assert word_counts(table(spark, [])).collect() == []
    assert variants(word_counts(table(spark, [(1, None)]))).collect() == []
    assert rows_of(variants(words_table(spark, {"alone": 3}))) == [("alone", None, "alone", 3, 0, None)]


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    for n, symbols in ((1, 2), (50, 3), (300, 4), (400, 90)):
        text = np.append(rng.integers(1, symbols + 1, n), 0)
        order = suffix_array(text)
        assert [tuple(text[i:]) for i in order] == sorted(tuple(text[i:]) for i in range(n + 1))
        index = Index(text, symbols + 2)
        for _ in range(50):
            low, high, c = *sorted(rng.integers(0, n + 2, 2)), rng.integers(0, symbols + 2)
            a, b, less = (int(x[0]) for x in index.walk(np.array([c]), np.array([low]), np.array([high])))
            part = index.bwt[low:high]
            assert b - a == (part == c).sum() and less == (part < c).sum() and a - index.base[c] == (index.bwt[:low] == c).sum()


def test_intervals_in_step():
    words = sorted({"banana", "bandana", "ananas", "nanna", "abana"})
    v = Vocabulary(words)
    text = "|" + "".join(w + "|" for w in words)
    low, other, size = np.array([0]), np.array([0]), np.array([v.size + 1])
    pattern = ""
    for left, letter in ((True, "a"), (False, "n"), (True, "n"), (False, "a"), (True, "a")):
        c = v.symbols_of(np.array([ord(letter)]))
        if left:
            pattern = letter + pattern
            low, other, size = v.ahead.extend(c, low, other, size)
        else:
            pattern += letter
            other, low, size = v.mirror.extend(c, other, low, size)
        starts = {i for i in range(len(text)) if text.startswith(pattern, i)}
        assert set(v.ahead.suffixes[low[0]:low[0] + size[0]].tolist()) == starts
        assert {len(text) - len(pattern) - i for i in v.mirror.suffixes[other[0]:other[0] + size[0]].tolist()} == starts


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_variants(brute_words([(r.doc_id, r.text) for r in docs.collect()]))
    assert rows_of(QUERIES["op11_spelling"](spark, SF)) == want and any(w[1] for w in want) and spelling.TILE_CHARS > 0
