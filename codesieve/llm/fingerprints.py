"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every position, the polynomial hash of what comes before it, modulo
two primes.  Any two spans are compared from four of its values, whatever their lengths, and the longest
common extension of two positions is found by binary search.  A fingerprint is the hash of the whole text with its
length, the hashes of its prefixes of geometrically growing lengths, and the least hashes among all spans of a
fixed width.  So the fingerprints of two texts tell how long they agree from the start on, and
estimate the share of spans that they have in common.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, id_bounds, texts

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
WIDTH = 24  # code points of a span
KEEP = 64  # least span hashes in a fingerprint
LADDER = sorted({ceil(1.15 ** j) for j in range(200)})  # lengths of prefixes, to beyond any text's

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_inverse: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(tables: list[np.ndarray], which: int, base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base, kept and doubled as longer texts come."""
    have, p = tables[which], np.uint64(PRIMES[which])
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), PRIMES[which])) % p))
    tables[which] = have
    return have[:n]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        codes = points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, np.uint64)
            # terms are below 2^31, so sums of up to 2^33 of them fit 64 bits
            np.cumsum(codes * _table(_powers, k, BASES[k], self.n) % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """The hash of a span; equal spans of any texts have equal hashes."""
        return tuple(int((int(s[start + length]) - int(s[start])) * pow(b, -start, p) % p) for s, b, p in zip(self.sums, BASES, PRIMES))

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of a width as 64-bit numbers, in the order of the text."""
        out = np.zeros(max(0, self.n - width + 1), np.uint64)
        for k, (s, p) in enumerate(zip(self.sums, PRIMES)):
            m = np.uint64(p)
            part = (s[width:] + m - s[:self.n + 1 - width]) % m if len(out) else out
            out = out << np.uint64(31) | part * _table(_inverse, k, pow(BASES[k], -1, p), len(out)) % m
        return out

    def common(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension: how far the text from ``start`` on and the other from ``at`` on agree."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(start, mid) == other.span(at, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def fingerprint(self) -> str:
        """n.whole.prefixes.spans in hex: the length, the whole text's hash, those of its prefixes and the least of its spans."""
        whole = "".join(f"{x:08x}" for x in self.span(0, self.n))
        prefixes = self.sums[0][LADDER[:bisect_left(LADDER, self.n)]].astype(">u4").tobytes().hex()
        mixed = self.spans(WIDTH) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed >>= np.uint64(32)
        share = 8 * KEEP / max(1, len(mixed))
        while share < 1:  # the least distinct ones are among those below a bound that enough of them meet
            low = np.unique(mixed[mixed < np.uint64(share * (1 << 32))])
            if len(low) >= KEEP:
                break
            share *= 4
        else:
            low = np.unique(mixed)
        return f"{self.n:x}.{whole}.{prefixes}.{low[:KEEP].astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Likeness of two texts from their fingerprints: 1 if these are equal, else the larger of the share of the longer
    text that lies in an agreed prefix and the estimated share of common spans."""
    if a == b:
        return 1.0
    (n, _, p, x), (m, _, q, y) = a.split("."), b.split(".")
    low, high = 0, min(len(p), len(q)) // 8  # agreement of prefixes ends once
    while low < high:
        mid = (low + high + 1) // 2
        if p[8 * mid - 8:8 * mid] == q[8 * mid - 8:8 * mid]:
            low = mid
        else:
            high = mid - 1
    prefix = (LADDER[low - 1] if low else 0) / max(int(n, 16), int(m, 16))
    x, y = ({s[i:i + 8] for i in range(0, len(s), 8)} for s in (x, y))
    least = sorted(x | y)[:KEEP]
    return max(prefix, sum(v in x and v in y for v in least) / len(least) if least else 0.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by the first as many code points of ``following``, or all."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


OUT = ("doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double, common_edited long, common_next long")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 2048) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, their likeness, and the likeness to the next document's.

    The next document is the one that follows in ascending order of doc_id, after the last the first;
    equal ids follow each other in the order of their texts.  Null texts are empty.  Rows without a
    doc_id have no place in that order: their next text is empty.  A single document is its own next.
    common_edited and common_next are the lengths of the common prefixes.  One row per input row; other columns are left out.

    Documents are dealt to contiguous id ranges; the first document of each range also goes to the range before it.  So
    texts are shuffled once, and a task holds two documents at a time.
    """
    bounds = id_bounds(df, id_col, range_rows)
    firsts, n = np.array(bounds, np.int64), max(1, len(bounds))
    known = set(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            out = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                if doc is None:
                    out.append((-1 - i % n, True, i))
                else:
                    part = int(np.searchsorted(firsts, doc, side="right")) - 1
                    out.append((part, True, i))
                    if doc in known:
                        out.append(((part - 1) % n, False, i))
            part, own, rows = zip(*out)
            rows = pa.array(rows, pa.int32())
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(own, pa.bool_()), batch.column("doc_id").take(rows),
                                   batch.column("text").take(rows)], names=["part", "own", "doc_id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def row(doc, text, hashes, print_, follow, follow_hashes, follow_print):
            new = edited(text, follow)
            new_hashes = Prefixes(new)
            new_print = new_hashes.fingerprint()
            return (doc, hashes.n, new, print_, new_print, likeness(print_, new_print), likeness(print_, follow_print),
                    hashes.common(0, new_hashes, 0), hashes.common(0, follow_hashes, 0))

        for batch in groups(batches):
            out = []
            for part, own, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "doc_id", "text"))):
                hashes = Prefixes(text)
                this = text, hashes, hashes.fingerprint()
                if part < 0:
                    out.append(row(doc, *this, "", Prefixes(""), EMPTY))
                    continue
                if last:
                    out.append(row(*last[1:], *(this if last[0] == part else ("", Prefixes(""), EMPTY))))
                # the rows that are not its own come after all others of a range; only the first of them follows anything
                last = (part, doc, *this) if own else None
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
        if last:  # no row may be lost, though every range ends with the first row of the next
            yield pa.record_batch([pa.array([c], f.type) for c, f in zip(row(*last[1:], "", Prefixes(""), EMPTY), ARROW)], schema=ARROW)

    dealt = texts(df, id_col, text_col).mapInArrow(deal, "part int, own boolean, doc_id long, text string")
    return (dealt.repartition("part").sortWithinPartitions("part", F.col("own").desc(), "doc_id", "text")
            .mapInArrow(compare, OUT))


EMPTY = Prefixes("").fingerprint()
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()),
                   ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                   ("common_edited", pa.int64()), ("common_next", pa.int64())])
