"""SentencePiece, packing, token counts, grammar files and fingerprints against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import fingerprints as fp
from codesieve.llm import grammar, packing, pieces, token_counts
from codesieve.llm.common import id_bounds, starts
from codesieve.llm.queries import BYTE_RANKS, END_OF_TEXT, PIECE_MODEL, WORD_MODEL
from codesieve.llm.words import Words

SCHEMA = "doc_id long, text string, ids string, sequence_id long, n_tokens string"  # with clashing names
LONG = "wort " * 30_000 + "x" * 20_000


def table(spark, rows):
    return spark.createDataFrame([(i, t, "a", 7, None) for i, t in rows], SCHEMA)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    parts = [*"aeinrst  ▁\n\t.,éßü中文😀\x00\x1c '0127AZ<>sx_#!", "the ", "ing", "  ", "<s>", "tion", "<|endoftext|>", "'s", "é", "\x85", " ", "Σ", "İ", "ǅ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


ROWS = [(3, "The the and.\nOf"), (1, None), (2, ""), (None, "null id"), (3, "The the and.\nOf"), (9, LONG), (5, "  two  spaces "), (7, "é中😀 token=abc"), (None, None)]


def test_pieces_equal_the_library():
    model = pieces.Pieces(PIECE_MODEL)
    for t in [*odd_texts(3000), "", " ", "a ", "x" * 500, "ab" * 300]:
        ids = np.frombuffer(model.encode(t), "<u4")
        assert ids.tolist() == model.library.encode(t, add_bos=True, add_eos=True)
        assert model.decode(ids) == model.library.decode(ids.tolist())
    model.check()


def test_pieces_decode_any_ids():
    model, rng = pieces.Pieces(PIECE_MODEL), random.Random(2)
    for _ in range(3000):
        ids = [rng.randrange(400) if rng.random() < 0.6 else rng.randrange(32_000) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.uint32)) == model.library.decode(ids)


def test_pieces_list_and_heap_agree():
    model = pieces.Pieces(PIECE_MODEL)
    for t in odd_texts(500, 3):
        assert model._by_list(t) == model._by_heap(t)


def test_encode_decode(spark):
    rows = pieces.encode_decode(table(spark, ROWS), PIECE_MODEL).collect()
    library = pieces.Pieces(PIECE_MODEL).library
    assert sorted((r.doc_id or -1, r.decoded) for r in rows) == sorted((i or -1, t or "") for i, t in ROWS)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.decoded, add_bos=True, add_eos=True) for r in rows)
    assert pieces.encode_decode(table(spark, []), PIECE_MODEL).collect() == []


def test_words_equal_the_library():
    words = Words(WORD_MODEL, remember=300)  # so small that it is emptied often
    texts = odd_texts(4000, 4)
    found = [words.wide(x) for i in range(0, 4000, 40) for x in words.encode(texts[i:i + 40])]
    assert found == [np.array(e.ids, "<u4").tobytes() for e in words.library.encode_batch(texts, add_special_tokens=False)]


def brute_ids(text, end):
    return [*Words(WORD_MODEL).library.encode(text or "", add_special_tokens=False).ids, end]


def test_cut_and_pack(spark):
    rows = packing.cut(table(spark, ROWS), WORD_MODEL, capacity=128).collect()
    docs = {}
    for r in sorted(rows, key=lambda r: (r.doc_id or -1, r.piece)):
        assert len(r.ids) == 4 * r.length and r.start == 128 * r.piece and r.length <= 128
        docs.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert docs[9] == brute_ids(LONG, 0) and docs[1] == [0] and docs[2] == [0]
    packed = packing.pack(packing.cut(table(spark, ROWS), WORD_MODEL, capacity=128), capacity=128)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    check_packing(packed.collect(), 128)
    assert packing.pack(packing.cut(table(spark, []), WORD_MODEL)).collect() == []


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_pack_close_to_the_bound(spark, seed):
    rng = random.Random(seed)
    lengths = [min(100, max(1, int(rng.expovariate(1 / 30)))) for _ in range(3000)] + [100] * 900 + [51] * 40
    rows = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "offset long, length int")
                        .withColumnRenamed("offset", "item"), capacity=100, part_rows=100).collect()
    assert len(rows) == len(lengths) and check_packing(rows, 100) <= best_fit_decreasing(lengths, 100) * 1.01 + 1


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_pack_leaves_what_does_not_fit(spark):
    rows = packing.pack(spark.createDataFrame([(None,), (0,), (-1,), (11,), (10,), (10,)], "length int"), capacity=10).collect()
    assert sorted((r.length is None, r.length or 0, r.sequence_id is None) for r in rows) == [
        (False, -1, True), (False, 0, True), (False, 10, False), (False, 10, False), (False, 11, True), (True, 0, True)]


def test_plan_is_bounded():
    few = packing.plan({n: 3 for n in range(1, 2049)}, 2048)
    many = packing.plan({n: 3_000_000_000 for n in range(1, 2049)}, 2048)
    assert len(many) <= 2 * len(few) <= 20_000


def test_token_counts(spark):
    folder = token_counts.write_files(table(spark, ROWS).coalesce(2), BYTE_RANKS, END_OF_TEXT, block_ids=64)
    blocks = token_counts.read_blocks(spark, folder)
    assert blocks.count() > 100  # the long text runs over many blocks
    found = token_counts.counts(blocks, END_OF_TEXT).join(token_counts.documents(spark, folder), ["file", "ordinal"])
    encoding = token_counts.byte_ranks(BYTE_RANKS)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found.collect()) == sorted((i or -1, len(encoding.encode_ordinary(t or "")) + 1) for i, t in ROWS)


def test_token_counts_of_any_stream(spark):
    rng = random.Random(5)
    for _ in range(5):
        stream = [rng.choice([9, 9, 1, 2, 3]) for _ in range(200)]
        cuts = sorted(rng.randrange(201) for _ in range(12))
        parts = [stream[a:b] for a, b in zip([0, *cuts], [*cuts, 200])]
        rows = [(0, i, bytearray(np.array(p, "<u2").tobytes())) for i, p in enumerate(parts)] + [(1, 0, None), (None, 0, bytearray(b"\x09\x00"))]
        got = token_counts.counts(spark.createDataFrame(rows, "file int, block long, tokens binary"), 9).orderBy("ordinal").collect()
        want, n = [], 0
        for x in stream:
            n += 1
            if x == 9:
                want.append(n)
                n = 0
        assert [r.n_tokens for r in got] == want + [n] * (n > 0)
    assert token_counts.counts(spark.createDataFrame([], "file int, block long, tokens binary"), 9).collect() == []


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 20, 5000), np.tile([1, 2, 3, 4], 2000), np.zeros(3000, int), np.array([5]), np.empty(0, int), rng.integers(0, 1 << 20, 4000).repeat(2)):
        row = grammar.pack_chunk([(1, ids.astype("<u4").tobytes())])
        g = grammar.unpack({**row})
        assert g.expand(g.sequence).tolist() == ids.tolist()
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert g.span(a, b - a).tolist() == ids[a:b].tolist()
    assert len(grammar.unpack(grammar.pack_chunk([(1, np.tile([1, 2, 3, 4], 2000).astype("<u4").tobytes())])).sequence) < 200


def test_grammar_files(spark):
    folder = grammar.write_files(grammar.encode(table(spark, ROWS), WORD_MODEL, shard_rows=2), chunk_tokens=50)
    files = grammar.read_files(spark, folder)
    chunks = starts(files.select("shard", "chunk", F.col("n_tokens").alias("n")), ["shard", "chunk"], "n").drop("n")
    rows = grammar.decode(files).join(chunks, ["shard", "chunk"]).withColumn("first", F.col("start") + F.col("at")).orderBy("first").collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, brute_key(r[1])))
    at = 0
    for r, (i, t) in zip(rows, order):
        ids = brute_ids(t, 1)
        assert (r.doc_id, r.first, r.n_tokens) == (i, at, len(ids)) and zlib.crc32(r.ids) == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(rows) == len(ROWS)
    empty = grammar.write_files(grammar.encode(table(spark, []), WORD_MODEL))
    assert grammar.decode(grammar.read_files(spark, empty)).collect() == []


def brute_key(text):
    return np.array(brute_ids(text, 1), "<u2").tobytes()


def test_prefix_hashes():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = fp.Prefixes(a), fp.Prefixes(b)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = rng.randint(0, min(len(a) - i, len(b) - j))
        assert (x.span(i, n) == y.span(j, n)) == (a[i:i + n] == b[j:j + n])
        same = next((k for k, (p, q) in enumerate(zip(a[i:], b[j:])) if p != q), min(len(a) - i, len(b) - j))
        assert x.common(i, y, j) == same
        spans = x.spans(3)
        for k in range(len(spans)):
            assert [m for m in range(len(spans)) if spans[m] == spans[k]] == [m for m in range(len(spans)) if a[m:m + 3] == a[k:k + 3]]


def test_likeness():
    rng = random.Random(7)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(2))
    f = lambda t: fp.Prefixes(t).fingerprint()
    assert fp.likeness(f(a), f(a)) == 1 and fp.likeness(f(a), f(b)) < 0.05 and fp.likeness(f(""), f(a)) == 0 and fp.likeness(f(""), f("")) == 1
    assert fp.likeness(f(a), f(a[:3000] + b[:1000])) > 0.5  # a common start
    assert 0.3 < fp.likeness(f(a), f(b[:1000] + a[1000:])) < 0.9  # common spans elsewhere


def test_fingerprints(spark):
    rows = [(i, "".join(random.Random(i).choice("ab \n") for _ in range(i % 13))) for i in range(50, 90)]
    rows += [(100, LONG), (70, "same id, another text"), (None, "no id"), (None, None), (101, None)]
    found = fp.fingerprints(table(spark, rows), range_rows=4).collect()
    order = sorted(((i, t or "") for i, t in rows if i is not None))
    want = {}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        want[i, fp.edited(t, n)] = len(t), fp.Prefixes(t).fingerprint(), next((m for m, (p, q) in enumerate(zip(t, n)) if p != q), min(len(t), len(n)))
    got = {(r.doc_id, r.edited): (r.n_chars, r.fingerprint, r.common_next) for r in found if r.doc_id is not None}
    assert got == want and len(found) == len(rows)
    assert sorted(r.edited for r in found if r.doc_id is None) == ["", fp.edited("no id", "")]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fp.fingerprints(table(spark, [(4, "abcdefgh")])).collect()[0].edited == "abcdefab"
    assert fp.fingerprints(table(spark, [])).collect() == []


def test_query_digests(spark):
    out = pieces.encode_decode(table(spark, [(1, "Aé")]), PIECE_MODEL).select(F.sha2("ids", 256).alias("a"), F.sha2(F.col("decoded").cast("binary"), 256).alias("b")).first()
    ids = pieces.Pieces(PIECE_MODEL).library.encode("Aé", add_bos=True, add_eos=True)
    assert out.a == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and out.b == hashlib.sha256("Aé".encode()).hexdigest()


@pytest.mark.parametrize("start,step", [(2 ** 61, 1), (-2 ** 63, 3), (2 ** 63 - 900, 2), (0, 2 ** 54 + 1)])
def test_no_document_is_lost_whatever_its_id(spark, start, step):
    """Also ids that doubles cannot tell apart, repeated ones at the bounds, and rows without any."""
    rng = random.Random(step)
    ids = [start + step * i for i in range(300)] + [start] * 3 + [start + step * 299] * 3 + [None] * 2
    rows = [(i, "".join(rng.choices("ab ", k=rng.randrange(9)))) for i in ids]
    got = fp.fingerprints(table(spark, rows).repartition(3), range_rows=8).collect()
    placed = sorted((i, t) for i, t in rows if i is not None)
    want = [(i, fp.edited(t, placed[(k + 1) % len(placed)][1])) for k, (i, t) in enumerate(placed)] + [(i, fp.edited(t, "")) for i, t in rows if i is None]
    assert sorted(((r.doc_id, r.edited) for r in got), key=repr) == sorted(want, key=repr)
    bounds = id_bounds(table(spark, rows), "doc_id", 8)
    assert bounds == sorted(set(bounds)) and set(bounds) <= set(ids) and bounds[0] == start
