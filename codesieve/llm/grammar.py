"""Token ids in grammar-compressed files (Re-Pair).

Documents in ascending order of their ids are dealt to shards of contiguous id ranges, and a shard
is a row of chunks.  In each chunk frequent pairs of adjacent ids are replaced, again and again, by
nonterminals.  A chunk is stored as its rules, the lengths that they expand to, the rest of the sequence, and
its documents' ids and token counts, so any span of ids is decoded without its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.session import shared_folder

from .common import groups, id_bounds, texts
from .words import WORD_GROUP, tokenizer

FILES = ("shard int, chunk int, n_tokens long, doc_ids array<long>, doc_tokens array<int>, base int, width int, "
         "rules binary, rule_ends array<int>, expansions binary, sequence binary")

# Pairs are counted among this many of the most frequent symbols at a time.
FREQUENT = 512


def compress(ids: np.ndarray, base: int, max_rules: int, min_count: int = 16, min_gain: float = 0.02):
    """(rules, rule_ends, sequence): rule i stands for symbol base + i, a pair of earlier symbols.

    Each round replaces, most frequent first, the pairs of which no symbol is the right half of one and the
    left half of another, so that only occurrences of a pair of one symbol overlap, in its runs.  It ends when a round saves
    less than ``min_gain`` of the sequence, or when there are ``max_rules`` rules (a bound of the format: symbols
    then still fit their width).  rule_ends are the numbers of rules after each round.
    """
    seq, rules, ends = ids.astype(np.int32), [], []
    while len(seq) > 1 and len(rules) < max_rules:
        freq = np.bincount(seq, minlength=base + len(rules))
        top = np.argpartition(freq, -min(FREQUENT, len(freq)))[-FREQUENT:]
        code = np.full(len(freq), FREQUENT, np.int32)
        code[top] = np.arange(len(top), dtype=np.int32)
        c = code[seq]
        pair = c[:-1] * np.int32(FREQUENT + 1) + c[1:]
        count = np.bincount(pair, minlength=(FREQUENT + 1) ** 2).reshape(FREQUENT + 1, FREQUENT + 1)
        count[FREQUENT], count[:, FREQUENT] = 0, 0
        count = count.ravel()
        count[::FREQUENT + 2] //= 2  # pairs of one symbol overlap in its runs
        best = np.flatnonzero(count >= min_count)
        best = best[np.argsort(-count[best], kind="stable")]
        role, symbol, gain = {}, np.zeros(len(count), np.int32), 0
        for p in best.tolist():
            a, b = divmod(p, FREQUENT + 1)
            if (a not in role) if a == b else (role.get(a, "left") == "left" and role.get(b, "right") == "right"):
                role[a], role[b] = ("both", "both") if a == b else ("left", "right")
                symbol[p] = base + len(rules)
                rules.append((int(top[a]), int(top[b])))
                gain += int(count[p])
                if len(rules) == max_rules:
                    break
        if not gain:
            break
        new = symbol[pair]
        at = np.flatnonzero(new)
        if "both" in role.values():  # of a run, every second pair
            run = (seq[at] == seq[at + 1])[1:] & (np.diff(at) == 1)
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate(([False], run)), 0, np.arange(len(at))))
            at = at[since % 2 == 0]
        seq[at] = new[at]
        seq = np.delete(seq, at + 1)
        ends.append(len(rules))
        if gain < min_gain * (len(seq) + gain):
            break
    return np.array(rules, np.int32).reshape(-1, 2), ends, seq


class Grammar:
    """Expansions of the rules of one chunk, and random access to its ids."""

    def __init__(self, base: int, rules: np.ndarray, rule_ends, sequence: np.ndarray, expansions: np.ndarray):
        self.sequence = sequence
        self.length = np.concatenate((np.ones(base, np.int64), expansions))
        self.offset = np.concatenate((np.arange(base), base + np.cumsum(expansions) - expansions))
        self.flat = np.arange(base, dtype=np.int64)
        start = 0
        for end in rule_ends:  # the rules of a round expand to symbols of earlier rounds
            self.flat = np.concatenate((self.flat, self.expand(rules[start:end].ravel())))
            start = end
        self.ends = np.cumsum(self.length[sequence])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.length[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.offset[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def span(self, start: int, length: int) -> np.ndarray:
        """The ids from ``start`` on, found by the lengths of expansions."""
        if length <= 0:
            return np.empty(0, np.int64)
        a, b = np.searchsorted(self.ends, [start, start + length - 1], side="right")
        skip = start - (self.ends[a - 1] if a else 0)
        return self.expand(self.sequence[a:b + 1])[skip:skip + length]


def expansion_lengths(base: int, rules: np.ndarray, rule_ends) -> np.ndarray:
    length, start = np.ones(base + len(rules), np.int64), 0
    for end in rule_ends:
        length[base + start:base + end] = length[rules[start:end]].sum(axis=1)
        start = end
    return length[base:]


def pack_chunk(docs: list[tuple[int | None, bytes]], kind: str = "<u4") -> dict:
    """A chunk of documents, (doc_id, ids as bytes of ``kind``) each."""
    ids, size = np.frombuffer(b"".join(x for _, x in docs), kind).astype(np.int64), np.dtype(kind).itemsize
    base = int(ids.max(initial=0)) + 1
    width = 2 if base < 60_000 else 4
    if base > 1 << 30:
        raise ValueError("ids above 2^30 are not supported")
    rules, ends, seq = compress(ids, base, max_rules=min(1 << 14, (1 << 16) - base) if width == 2 else 1 << 14)
    kind = f"<u{width}"
    return {"n_tokens": len(ids), "doc_ids": [d for d, _ in docs], "doc_tokens": [len(x) // size for _, x in docs], "base": base, "width": width,
            "rules": rules.astype(kind).tobytes(), "rule_ends": ends, "expansions": expansion_lengths(base, rules, ends).astype("<u4").tobytes(),
            "sequence": seq.astype(kind).tobytes()}


def unpack(row: dict) -> Grammar:
    kind = f"<u{row['width']}"
    return Grammar(row["base"], np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.int64), row["rule_ends"],
                   np.frombuffer(row["sequence"], kind).astype(np.int64), np.frombuffer(row["expansions"], "<u4").astype(np.int64))


def encode(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 4096) -> DataFrame:
    """Ids of every whole text with the end id, and the shard (id range) of its document: (shard, doc_id, width, ids),
    ids as little-endian unsigned integers of ``width`` bytes.

    A null text is empty.  Documents without a doc_id come before all others.
    """
    bounds = np.array(id_bounds(df, id_col, shard_rows)[1:], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        end = np.array([end_id], words.kind).tobytes()
        for batch in groups(batches, chars=WORD_GROUP):
            ids = [x + end for x in words.encode(batch.column("text").to_pylist())]
            shard = [0 if d is None else int(np.searchsorted(bounds, d, side="right")) for d in batch.column("doc_id").to_pylist()]
            yield pa.record_batch([pa.array(shard, pa.int32()), batch.column("doc_id"), pa.array([len(end)] * len(ids), pa.int32()),
                                   pa.array(ids, pa.binary())], names=["shard", "doc_id", "width", "ids"])

    return texts(df, id_col, text_col).mapInArrow(run, "shard int, doc_id long, width int, ids binary")


def write_files(encoded: DataFrame, chunk_tokens: int = 1_000_000, folder: str | None = None) -> str:
    """Write (shard, doc_id, width, ids) as grammar-compressed files; returns the folder.

    Documents of a shard stand in ascending order of doc_id, equal ids in the order of their tokens.
    A chunk is closed when it holds ``chunk_tokens`` ids or its shard ends; no document is split, and a task holds one
    chunk at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard, width, chunk = [], 0, None, None, 0

        def close():
            row = {"shard": shard, "chunk": chunk, **pack_chunk(held, f"<u{width}")}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for s, doc, w, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "width", "ids"))):
                if held and (s != shard or w != width or size >= chunk_tokens):
                    yield close()
                    held, size, chunk = [], 0, chunk + 1 if s == shard else 0
                shard, width = s, w
                held.append((doc, ids))
                size += len(ids) // w
        if held:
            yield close()

    folder = folder or shared_folder(encoded.sparkSession, "grammar")
    dealt = encoded.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    dealt.mapInArrow(run, FILES).write.option("compression", "zstd").parquet(folder)
    return folder


ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                   ("doc_tokens", pa.list_(pa.int32())), ("base", pa.int32()), ("width", pa.int32()), ("rules", pa.binary()),
                   ("rule_ends", pa.list_(pa.int32())), ("expansions", pa.binary()), ("sequence", pa.binary())])


def read_files(spark, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(folder)


def decode(files: DataFrame) -> DataFrame:
    """Every document of the files: (shard, chunk, at, doc_id, n_tokens, ids), ``at`` counting ids from the start of the chunk.

    An empty table of files gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar, n = unpack(row), np.array(row["doc_tokens"], np.int64)
                raw, ends = grammar.expand(grammar.sequence).astype("<u4").tobytes(), np.cumsum(n)
                m = len(n)
                yield pa.record_batch([
                    pa.array([row["shard"]] * m, pa.int32()), pa.array([row["chunk"]] * m, pa.int32()), pa.array(ends - n, pa.int64()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(n, pa.int64()),
                    pa.array([raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())],
                    names=["shard", "chunk", "at", "doc_id", "n_tokens", "ids"])

    return files.mapInArrow(run, "shard int, chunk int, at long, doc_id long, n_tokens long, ids binary")
