"""Token counts of documents in flat token files.

A token file is one stream of ids, document after document, each closed by the end-of-document id.
Nothing in it says where documents start.  It is stored as blocks of a fixed number of ids, so that a
document may begin in one block and end in another, or run over many.  Counting looks for the end id in whole
blocks at once; a prefix scan over the blocks' numbers of ends gives every part of a document the
ordinal of its document, and the parts are summed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.session import shared_folder

from .common import groups, texts

FILES = "file int, block long, tokens binary, doc_ids array<long>"
PARTS = "file int, block long, ends int, ordinal int, n_tokens long"


@lru_cache(maxsize=2)
def byte_ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_files(df: DataFrame, ranks_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                block_ids: int = 1 << 18, folder: str | None = None) -> str:
    """Write the ids of every whole text as flat token files; returns the folder.

    One file per task, as rows (file, block, tokens): unsigned 16-bit ids where they fit, else 32-bit.  A list of
    each file's doc_ids in the order of its documents stands beside it (rows with
    ``doc_ids``); it holds no positions.  Null texts are empty documents: the end id alone.
    Null and repeated doc_ids are kept as they are.
    """
    kind = "<u2" if end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file, block, listed = byte_ranks(ranks_path), TaskContext.get().partitionId(), 0, 0
        pending, size, docs = [], 0, []

        def rows(tokens, ids, at):
            return pa.record_batch([pa.array([file], pa.int32()), pa.array([at], pa.int64()), pa.array([tokens], pa.binary()),
                                    pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "tokens", "doc_ids"])

        for batch in groups(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encoding.encode_ordinary(text), end_id], kind)
                pending.append(ids)
                docs.append(doc)
                size += len(ids)
            if size >= block_ids:
                flat = np.concatenate(pending)
                for i in range(0, size - size % block_ids, block_ids):
                    yield rows(flat[i:i + block_ids].tobytes(), None, block)
                    block += 1
                pending, size = [flat[size - size % block_ids:].copy()], size % block_ids
            if len(docs) >= 10_000:
                yield rows(None, docs, listed)
                docs, listed = [], listed + 1
        if size:
            yield rows(np.concatenate(pending).tobytes(), None, block)
        if docs:
            yield rows(None, docs, listed)

    folder = folder or shared_folder(df.sparkSession, "token-files")
    files = texts(df, id_col, text_col).mapInArrow(run, FILES)
    files.withColumn("kind", F.when(F.col("tokens").isNull(), "ids").otherwise("tokens")).write.partitionBy("kind") \
        .option("compression", "zstd").parquet(folder)
    return folder


def read_blocks(spark, folder: str) -> DataFrame:
    """The blocks of token files: (file, block, tokens)."""
    return spark.read.schema(FILES + ", kind string").parquet(folder).where("kind = 'tokens'").select("file", "block", "tokens")


def counts(blocks: DataFrame, end_id: int) -> DataFrame:
    """Number of ids of every document of the files, its end id included: (file, ordinal, n_tokens).

    ``blocks`` are rows (file, block, tokens), blocks numbered from 0 in the order of the stream and of any length,
    empty or null ones included.  Ordinals count the documents of a file from 0.  Ids after the
    last end id are a last document without an end.  A row that is repeated counts twice,
    as the stream then has it twice.  Rows with a null file or block are left out: they have no place in a stream.
    The scan over the blocks of a file handles one small row per block.
    """
    kind = "<u2" if end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, raw in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("tokens").to_pylist()):
                ids = np.frombuffer(raw or b"", kind)
                ends = np.flatnonzero(ids == end_id)
                n = np.diff(ends, prepend=-1)
                if len(ids) - 1 > (ends[-1] if len(ends) else -1):  # what runs on into the next block
                    n = np.append(n, len(ids) - 1 - (ends[-1] if len(ends) else -1))
                # a row with ordinal -1 tells the block's number of ends, even if the block has no part
                m = len(n) + 1
                yield pa.record_batch([pa.array([file] * m, pa.int32()), pa.array([block] * m, pa.int64()), pa.array([len(ends)] * m, pa.int32()),
                                       pa.array(np.arange(-1, m - 1), pa.int32()), pa.array(np.concatenate(([0], n)), pa.int64())],
                                      names=["file", "block", "ends", "ordinal", "n_tokens"])

    # Blocks that are given twice are told apart by nothing, so their ordinals run on in any order.
    parts = blocks.where("file is not null and block is not null").select("file", "block", "tokens").mapInArrow(run, PARTS)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = (parts.where("ordinal = -1").groupBy("file", "block").agg(F.sum("ends").alias("n"))
             .select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first")))
    return (parts.where("ordinal >= 0").join(first, ["file", "block"])
            .groupBy("file", (F.col("first") + F.col("ordinal")).alias("ordinal")).agg(F.sum("n_tokens").alias("n_tokens")))


def documents(spark, folder: str) -> DataFrame:
    """(file, ordinal, doc_id) from the lists beside the token files."""
    lists = spark.read.schema(FILES + ", kind string").parquet(folder).where("kind = 'ids'").select("file", "block", "doc_ids")
    return lists.select("file", F.posexplode("doc_ids").alias("pos", "doc_id"), "block") \
        .withColumn("pos", F.col("pos").cast("long")) \
        .join(_list_starts(lists), ["file", "block"]).select("file", (F.col("start") + F.col("pos")).alias("ordinal"), "doc_id")


def _list_starts(lists: DataFrame) -> DataFrame:
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return lists.select("file", "block", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)).cast("long").alias("start"))
