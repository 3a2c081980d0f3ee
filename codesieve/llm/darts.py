"""Near-duplicate documents by DartMinHash.

A document is a weighted set of five-word shingles.  Every shingle owns a strip of the plane, as high as its
weight; hashed darts hit the plane at one dart per unit area, and a dart is thrown only where it can matter: at weights below
the shingle's and ranks below a bound that falls with the document's total weight.  Each dart belongs to one
coordinate, and the signature holds the earliest dart of each.  Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity.  Coordinates are joined in bands; candidates are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.session import written

from .common import components, forest, groups, texts

BASE = 0x9DDFEA08EB382D69  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
WORDS = 5
_FRACTION = 30  # bits of a rank after the point


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
    _tables[base] = have
    return have[:n]


def shingles(rows: list[str]) -> list[np.ndarray]:
    """Sorted hashes of the five-word shingles of each text, with repeats; a text of fewer words is one shingle, one
    without words none.  Words are what white space separates, in lower case."""
    clean = [" ".join(t.lower().split()).encode("utf-8", "surrogatepass") for t in rows]
    raw = np.frombuffer(b" ".join(clean) + b" ", np.uint8)
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
    gaps = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], gaps[:-1] + 1))
    word = mix((sums[gaps] - sums[starts]) * _powers(INVERSE, n)[starts])
    word, starts = word[gaps > starts], starts[gaps > starts]  # empty texts leave empty words
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(c) + 1 for c in clean]))))
    m = max(0, len(word) - WORDS + 1)
    five = np.zeros(m, np.uint64)
    for i in range(WORDS):
        five = mix(five * np.uint64(31) + word[i:i + m])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            own = five[a:b - WORDS + 1].copy()
            own.sort()
        else:
            own = np.zeros(int(b > a), np.uint64)
            for w in word[a:b]:
                own = mix(own * np.uint64(31) + w)
        out.append(own)
    return out


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of ``k`` earliest ranks for each weighted set (element hashes, weights above 0), none of them empty.

    Equal ranks in a coordinate mean the same dart.  About k ln k + 2k darts are thrown for a set, whatever its size; sets of which some
    coordinate got none are thrown again up to twice the rank.
    """
    out = np.zeros((len(sets), k), np.uint64)
    todo, reach = list(range(len(sets))), k * math.log(max(2, k)) + 2 * k
    total = np.array([float(w.sum()) for _, w in sets])
    while todo:
        bound = reach / total[todo]
        size = [len(sets[i][0]) for i in todo]
        doc = np.repeat(np.arange(len(todo)), size)
        element = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo])
        # unit cells of each element's strip: its weight rounded up times the bound rounded up
        wide, high = np.ceil(weight).astype(np.int64), np.ceil(bound).astype(np.int64)[doc]
        cells = wide * high
        at = np.repeat(np.arange(len(element)), cells)
        number = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        column, row = number // high[at], number % high[at]
        seed = mix(element[at] + mix((column.astype(np.uint64) << np.uint64(32)) + row.astype(np.uint64) + np.uint64(1)))
        darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)) * 2.0 ** -53)
        pick = np.repeat(np.arange(len(at)), darts)
        nth = np.arange(len(pick)) - np.repeat(np.cumsum(darts) - darts, darts)
        hashed = mix(seed[pick] + np.uint64(0x9E3779B97F4A7C15) * (nth.astype(np.uint64) + np.uint64(1)))
        rank = (row[pick].astype(np.uint64) << np.uint64(_FRACTION)) + (hashed >> np.uint64(64 - _FRACTION))
        other = mix(hashed + np.uint64(1))
        where = at[pick]
        inside = (column[pick] + (other >> np.uint64(40)) * 2.0 ** -24 < weight[where]) & (rank < (bound * (1 << _FRACTION)).astype(np.uint64)[doc[where]])
        spot = doc[where].astype(np.uint64) * np.uint64(k) + (other & np.uint64(0xFFFFFFFF)) % np.uint64(k)
        order = np.lexsort((rank[inside], spot[inside]))
        spot, rank = spot[inside][order], rank[inside][order]
        first = np.concatenate((spot[:1] == spot[:1], spot[1:] != spot[:-1]))
        spot, rank = spot[first].astype(np.int64), rank[first]
        full = np.bincount(spot // k, minlength=len(todo)) == k
        own = full[spot // k]
        out[np.array(todo)[spot[own] // k], spot[own] % k] = rank[own]
        todo, reach = [i for i, done in zip(todo, full) if not done], 2 * reach
    return out


def weighted(hashes: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements with weight 1, or with their numbers ("count")."""
    values, n = np.unique(hashes, return_counts=True)
    return values, n.astype(float) if weights == "count" else np.ones(len(values))


def elements(hashes: np.ndarray, weights: str) -> np.ndarray:
    """The weighted set as a plain one, sorted: an element of weight n is n elements, so weighted similarity is that of plain sets."""
    values, first, n = np.unique(hashes, return_index=True, return_counts=True)
    if weights != "count":
        return values
    return np.unique(mix(hashes + (np.arange(len(hashes)) - np.repeat(first, n)).astype(np.uint64) * np.uint64(BASE)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct elements; 0 if one is empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def similarities(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Jaccard similarities of all pairs of two lists of sets, from the elements that both lists hold."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    rows = []
    for sets in (left, right):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        rows.append((owner[hit], at[hit]))
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), step):
        x, y = (np.zeros((len(sets), step), np.float32) for sets in (left, right))
        for matrix, (owner, at) in zip((x, y), rows):
            own = (at >= start) & (at < start + step)
            matrix[owner[own], at[own] - start] = 1
        both += x @ y.T
    size = np.array([len(s) for s in left], float)[:, None] + np.array([len(s) for s in right], float)
    return both / np.maximum(size - both, 1)


def signatures(df: DataFrame, bands: int, rows: int, weights: str = "set", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, high, low, bands): the 128-bit hash of the weighted set and the hashes of its bands; null for texts without words."""
    schema = "doc_id long, high long, low long, bands array<long>"
    names = ["doc_id", "high", "low", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1).astype(np.uint64))
        for batch in groups(batches):
            sets = [weighted(s, weights) for s in shingles(batch.column("text").to_pylist())]
            some = [i for i, (s, _) in enumerate(sets) if len(s)]
            high, low, keys = ([None] * len(sets) for _ in range(3))
            if some:
                found = dart_signatures([sets[i] for i in some], bands * rows).reshape(len(some), bands, rows)
                band = np.broadcast_to(salt, (len(some), bands))
                for r in range(rows):
                    band = mix(band * np.uint64(31) + found[:, :, r])
                for i, b in zip(some, band.astype(np.int64)):
                    s, w = sets[i]
                    marked = mix(s + w.astype(np.uint64) * np.uint64(BASE))
                    high[i], low[i] = (int(mix(x.sum(keepdims=True) + np.uint64(len(s))).astype(np.int64)[0]) for x in (marked, mix(marked + np.uint64(7))))
                    keys[i] = b
            yield pa.record_batch([batch.column("doc_id"), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, hashes) have at least that similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = [similarity(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) >= least
                     for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    return (pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def across(placed: DataFrame, sets: DataFrame, least: float, block: int = 256) -> DataFrame:
    """Links (a, b) between members of different components in the buckets ``placed`` (band, rep, part), as a forest.

    In each bucket, the members outside its largest component are compared with all members that are not in theirs, in blocks of
    about ``block`` each; pairs are counted inside a block and never become rows.
    """
    def run(table: pa.Table) -> pa.Table:
        probe, reps, parts = (np.asarray(table.column(c)) for c in ("probe", "rep", "part"))
        found = [np.frombuffer(x.as_py(), "<u8") for x in table.column("hashes")]
        left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        close = similarities([found[i] for i in left], [found[i] for i in right]) >= least
        close &= parts[left][:, None] != parts[right]
        i, j = np.nonzero(close)
        ids, at = np.unique(np.concatenate((reps[left], reps[right])), return_inverse=True)
        root = ids[forest(at[:len(left)][i], at[len(left):][j], len(ids))]
        some = root != ids
        return pa.table({"a": pa.array(ids[some]), "b": pa.array(root[some])})

    sizes = placed.groupBy("band", "part").agg(F.count("*").alias("n"))
    mixed = (sizes.groupBy("band").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("main"))
             .where("kinds > 1")
             .select("band", "main", F.ceil(F.col("all") / block).alias("members"), F.ceil((F.col("all") - F.col("most")) / block).alias("probes")))
    rest = placed.join(mixed, "band").withColumns({"m": F.pmod(F.xxhash64("rep"), "members"), "p": F.pmod(F.xxhash64("rep", F.lit(1)), "probes")})
    last = F.lit(1).cast("long")
    members = rest.select("band", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("probes") - last)).alias("p"), "rep", "part", F.lit(False).alias("probe"))
    probes = rest.where("part != main").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("members") - last)).alias("m"), "p", "rep", "part", F.lit(True).alias("probe"))
    return (members.unionByName(probes).join(sets.select(F.col("id").alias("rep"), "hashes"), "rep")
            .select("band", "m", "p", "rep", "part", "probe", "hashes").groupBy("band", "m", "p").applyInArrow(run, "a long, b long"))


def near_duplicates(df: DataFrame, least: float = 0.8, bands: int = 26, rows: int = 5, weights: str = "set",
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, kept) for every row: the least doc_id that is reached over links of similarity ``least`` or more, and
    whether that is the row's own.

    Texts with equal sets are linked without comparison and stand for each other from then on.  A link of
    similarity 0.8 is missed with a probability of 3e-5, a closer one with less.  Texts without words link with nothing.
    Rows that share a doc_id are one document; a null doc_id has a null class, belongs to no group and is kept.  Null texts are empty.

    In each bucket of a band, all members are compared with its least one; then, where a bucket still holds members of
    different components, those outside its largest component are compared with all that are not in theirs.  So most of a large group of
    near copies costs one comparison per member and band, no candidate pair between components is left out, and no step makes a row for
    each pair of a bucket.
    """
    spark = df.sparkSession
    base = written(signatures(df, bands, rows, weights, id_col, text_col), "darts")
    known = base.where("doc_id is not null and high is not null")
    # one row for each distinct set: the bands follow from the set
    reps = written(known.groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "darts-sets")
    buckets = reps.select("rep", F.posexplode("bands").alias("no", "band")).select("rep", F.xxhash64("no", "band").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(buckets.join(hubs, "band"), "darts-buckets")
    # the sets of the documents that are in some bucket with others; the same id may stand for two sets, which are one document then
    texts_of = texts(df, id_col, text_col).join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches):
            found = [elements(s, weights).astype("<u8").tobytes() for s in shingles(batch.column("text").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], names=["id", "hashes"])

    sets = written(texts_of.mapInArrow(run, "id long, hashes binary"), "darts-candidates")
    first = members.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(verified(first, sets, least), "darts-links")
    comp = components(links, "darts-components")
    placed = written(members.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("part")), "darts-placed")
    more = written(across(placed, sets, least), "darts-links")
    comp = components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "darts-components")

    classes = (reps.select("high", "low", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
               .select("high", "low", F.coalesce("component", "rep").alias("class_id")))
    every = base.select("doc_id", "high", "low").join(classes, ["high", "low"], "left")
    return every.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")) \
        .withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))
