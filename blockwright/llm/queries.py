"""The thin queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontam, html, jpeg, langid, quality, secret_scan, simhash, suffix_dedup, trie, urls, warc
from .common import own_session
from .common import table as read_table

#: Where the public tokenizers' files are; a parameter of the operator.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; the session of a query keeps its batches of texts small and its scans alike."""
    own_session(spark)
    return read_table(spark, sf_dir, name)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("redacted").withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_columns(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed").withColumnRenamed("id", "doc_id")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_bpe": op1_bpe, "op2_urls": op2_urls, "op3_secrets": op3_secrets, "op4_warc": op4_warc, "op5_simhash": op5_simhash,
    "op6_language": op6_language, "op7_decontamination": op7_decontamination, "op8_html": op8_html, "op9_quality": op9_quality, "op10_jpeg": op10_jpeg,
    "op11_suffixes": op11_suffixes, "op12_trie": op12_trie, "op13_centroids": op13_centroids,
}
ORACLE_SQL: dict[str, str] = {"op2_urls": urls.oracle(), "op4_warc": warc.ORACLE, "op12_trie": trie.ORACLE, "op13_centroids": centroids.oracle()}
