"""One query per operator, on the whole intended table, and the SQL that expresses it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm import bpe, classifier, lines, media, mixing, nndescent, secret_scan, simhash, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from two co-trained views."""
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_vantage_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: three-word shingles, links at two bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by the rules' trigram queries."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op5_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the ranks of a public vocabulary."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an image in an archive, read back through the data source."""
    return media.round_trip(table(spark, sf_dir, "documents"))


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines that stand elsewhere first."""
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents in ascending doc_id order, read back."""
    import public_tokenizers

    return tokens.digest(tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the curriculum takes from every document, in training order."""
    return mixing.query(table(spark, sf_dir, "documents"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, read back and reassembled."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cotrained_quality": op1_cotrained_quality,
        "op2_simhash_vantage_tree": op2_simhash_vantage_tree,
        "op3_nn_descent": op3_nn_descent,
        "op4_trigram_secrets": op4_trigram_secrets,
        "op5_bpe_merge_replay": op5_bpe_merge_replay,
        "op6_media_archive": op6_media_archive,
        "op7_line_chunks": op7_line_chunks,
        "op8_elias_fano_ids": op8_elias_fano_ids,
        "op9_curriculum_mix": op9_curriculum_mix,
        "op10_warc_segments": op10_warc_segments,
    }


#: Pages with equal html of 100 bytes or more refer to the smallest of their ids.
OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_trigram_secrets": secret_scan.sql(),
        "op7_line_chunks": lines.SQL,
        "op9_curriculum_mix": mixing.SQL,
        "op10_warc_segments": OP10,
    }
