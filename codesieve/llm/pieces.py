"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut into segments that no merge can span, each segment is merged with an
agenda of adjacent symbol pairs in the order of their scores, and what a segment
gave is remembered for the next text.  New segments of every Arrow batch are
compared with the sentencepiece library, so a model that this code reads wrongly
stops the job instead of giving wrong ids.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import groups, texts

SPACE = "▁"
BREAK = b"\xff"  # stands for a control id in what is decoded; byte pieces with this value become BAD
BAD = b"\xfe"  # a byte that no character holds either
SCHEMA = "doc_id long, ids binary, decoded string"

codecs.register_error("codesieve_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A merge-type vocabulary: ``encode`` and ``decode`` of single texts.

    ``remember`` bounds the segments kept in memory; longer ones than 64 characters
    are never kept.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or kinds & {4, 5} \
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces \
                or train.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type vocabulary with byte fallback and plain text normalisation")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.order = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        # Cutting before a space sign that follows another character is safe only if no piece holds that.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        plain = {i: p.encode() for p, i in ((p.replace(SPACE, " "), i) for p, i in self.ids.items())}
        plain |= {i: bytes([b]) if b < 255 else BAD for b, i in self.bytes.items()}
        self.surface = [plain.get(i, " ⁇ ".encode() if p.type == 2 else BREAK) for i, p in enumerate(model.pieces)]
        self.spaced = {i for p, i in self.ids.items() if p[0] == SPACE}
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.fresh: list[tuple[str, list[int]]] = []

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment: the best-scored adjacent pair merges first, the leftmost of equals.

        The agenda is a list of the scores of all pairs for short segments, a heap for longer ones.
        """
        out = []
        for part in self._by_list(segment) if len(segment) <= 32 else self._by_heap(segment):
            i = self.ids.get(part)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in part.encode()]
        return out

    def _by_list(self, segment: str) -> list[str]:
        score, never = self.order.get, float("inf")
        parts = list(segment)
        agenda = [score(a + b, never) for a, b in zip(segment, segment[1:])]
        while agenda and (best := min(agenda)) != never:
            i = agenda.index(best)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(parts[i] + parts[i + 1], never)
            if i:
                agenda[i - 1] = score(parts[i - 1] + parts[i], never)
        return parts

    def _by_heap(self, segment: str) -> list[str]:
        parts: list[str | None] = list(segment)
        n, order = len(parts), self.order
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            score = order.get(segment[i:i + 2])
            if score is not None:
                agenda.append((score, i, 2))
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left = parts[i]
            if left is None or (j := after[i]) == n or len(left) + len(parts[j]) != size:
                continue  # one of the two has merged otherwise since
            parts[i] = left = left + parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (score := order.get(pair := left + parts[k])) is not None:
                    heappush(agenda, (score, i, len(pair)))
            if (h := before[i]) >= 0 and (score := order.get(pair := parts[h] + left)) is not None:
                heappush(agenda, (score, h, len(pair)))
        return [part for part in parts if part is not None]

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each without the space sign it starts with."""
        if not self.cuts:
            return [text.replace(" ", SPACE)]
        if SPACE not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [s[1:] for s in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        known, found = self.known, []
        if text:
            for s in self.segments(text):
                ids = known.get(s)
                if ids is None:
                    merged = self.merge(SPACE + s)
                    ids = pack(f"<{len(merged)}I", *merged)
                    if s:
                        self.fresh.append((s, merged))
                    if len(s) <= 64:
                        if len(known) >= self.remember:
                            known.clear()
                        known[s] = ids
                found.append(ids)
        return np.uint32(self.begin).tobytes() + b"".join(found) + np.uint32(self.end).tobytes()

    def check(self) -> None:
        """Compare the segments merged since the last call with the library."""
        fresh, self.fresh = self.fresh, []
        if self.library.encode([s.replace(SPACE, " ") for s, _ in fresh], num_threads=1) != [ids for _, ids in fresh]:
            raise RuntimeError("ids differ from the sentencepiece library")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: space signs as spaces, the one put before the text taken off,
        byte pieces as UTF-8 with one replacement character for each wrong byte."""
        surface, ids = self.surface, ids.tolist()
        raw = [surface[i] for i in ids]
        first = next((i for i, x in zip(ids, raw) if x is not BREAK), None)
        text = b"".join(raw)
        if BREAK in text.strip(BREAK):  # a control id between byte pieces ends their character
            text = "".join(part.decode("utf-8", "codesieve_each_byte") for part in text.split(BREAK))
        else:
            text = text.strip(BREAK).decode("utf-8", "codesieve_each_byte")
        return text[first in self.spaced:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Ids of every whole text, and the text decoded from these ids.

    Returns doc_id, ids (little-endian unsigned 32-bit integers with begin and end
    ids) and decoded (null without ``decode``): one row per input row, repeated rows
    included.  A null text is an empty one: begin and end only.  A null doc_id stays
    null.  Other columns are left out.  No shuffle; memory is bounded by one
    group of texts and the remembered segments.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path)
        for batch in groups(batches):
            ids = [model.encode(t) for t in batch.column("text").to_pylist()]
            model.check()
            back = [model.decode(np.frombuffer(x, "<u4")) for x in ids] if decode else [None] * len(ids)
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return texts(df, id_col, text_col).mapInArrow(run, SCHEMA)
