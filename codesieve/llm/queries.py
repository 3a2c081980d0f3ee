"""The registered queries of this package, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_OF_TEXT = 50256


def op1_sentencepiece(spark, sf_dir):
    from .pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL).select(
        "doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_best_fit_packing(spark, sf_dir):
    from .packing import cut, pack

    pieces = cut(table(spark, sf_dir, "documents"), WORD_MODEL, capacity=2048, end_id=0)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


def op3_embedding_near_dedup(spark, sf_dir):
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op4_secret_scans(spark, sf_dir):
    from .secret_index import BASE_RULES, joined, scan

    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["number"] < len(BASE_RULES))
    counts = [F.size(F.filter(F.col("found.number"), lambda n: n == F.lit(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op5_fingerprints(spark, sf_dir):
    from .fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "common_edited", "common_next")


def op6_token_counts(spark, sf_dir):
    from .token_counts import counts, documents, read_blocks, write_files

    folder = write_files(table(spark, sf_dir, "documents"), BYTE_RANKS, end_id=END_OF_TEXT)
    return (counts(read_blocks(spark, folder), END_OF_TEXT).join(documents(spark, folder), ["file", "ordinal"])
            .select("doc_id", "n_tokens"))


URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op7_url_filters(spark, sf_dir):
    from .urls import Rule, judge

    return judge(table(spark, sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


def op8_language_id(spark, sf_dir):
    from .language import held_out, scores, train

    docs = table(spark, sf_dir, "documents")
    models, limit = train(docs, fold=~held_out(F.col("doc_id")))
    return scores(docs, models).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy",
                                       F.coalesce(F.col("entropy") <= limit, F.lit(False)).alias("accepted"))


def op10_dart_minhash(spark, sf_dir):
    from .darts import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_grammar_files(spark, sf_dir):
    from .common import starts
    from .grammar import decode, encode, read_files, write_files

    files = read_files(spark, write_files(encode(table(spark, sf_dir, "documents"), WORD_MODEL, end_id=1)))
    chunks = starts(files.select("shard", "chunk", F.col("n_tokens").alias("n")), ["shard", "chunk"], "n").drop("n")
    return (decode(files).select("shard", "chunk", "at", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
            .join(chunks, ["shard", "chunk"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def op11_spelling(spark, sf_dir):
    from .spelling import variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents"), least_chars=5, least_n=3, slip=97), factor=2)


def op12_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=8).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_warc(spark, sf_dir):
    from .warc import convert, pages, write_arc

    return pages(spark, convert(spark, write_arc(table(spark, sf_dir, "pages")), least_bytes=1000)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_best_fit_packing, op3_embedding_near_dedup, op4_secret_scans, op5_fingerprints, op6_token_counts,
    op7_url_filters, op8_language_id, op9_grammar_files, op10_dart_minhash, op11_spelling, op12_whitening, op13_warc)}


def _secrets_sql() -> str:
    """The spans of every rule from its matches and the texts between them."""
    from .secret_index import BASE_RULES, RULES

    def spans(i, r):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        return f"""SELECT doc_id, {i} AS number, '{r.kind}' AS kind, start, start + length(m[k]) AS stop FROM (
  SELECT *, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
    SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, regexp_split_to_array(t, {pattern}) AS p
    FROM d WHERE regexp_matches(t, {pattern})))) WHERE length(g[k]) >= {r.least}"""

    shown = "kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR)"
    counts = ", ".join(f"count(*) FILTER (WHERE number = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(spans(i, r) for i, r in enumerate(RULES))})
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({shown}, ',' ORDER BY start, number) FILTER (WHERE number < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg({shown}, ',' ORDER BY start, number), '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, max(page_id) OVER (PARTITION BY t) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id != kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id != kept THEN kept END AS refers_to, true AS verified FROM q"""

ORACLE: dict[str, str] = {"op4_secret_scans": _secrets_sql(), "op13_warc": WARC_SQL}
