"""A corpus pipeline of the operators in codesieve.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet and read again.  All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codesieve.llm import darts, language, packing, secret_index
from codesieve.llm.queries import WORD_MODEL
from codesieve.session import written


def language_id(spark, docs, sf_dir):
    """Documents that fit one of the learned languages; what has no letter or fits none of them goes."""
    models, limit = language.train(docs)
    return language.accepted(docs, models, limit)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: the one with the least doc_id."""
    classes = darts.near_duplicates(docs)
    return docs.join(classes.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark, docs, sf_dir):
    """All documents, with the secrets in their texts masked and n_chars counted anew."""
    spans = "found"
    while spans in map(str.lower, docs.columns):
        spans += "_"
    found = secret_index.scan(docs, carry=tuple(c for c in docs.columns if c != "text"), found=spans)
    text = secret_index.masked(F.col("text"), F.col(spans))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark, docs, sf_dir):
    """The documents' token pieces in sequences of at most 2048 tokens."""
    pieces = packing.cut(docs, WORD_MODEL, capacity=2048, end_id=0)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


STAGES = [
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

# Language models and signatures can't be stated in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
