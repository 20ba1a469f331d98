"""A corpus pipeline of five stages; each works on all that its predecessor kept.

In every stage null ids, repeated rows and further columns pass through as they are, an empty table gives an empty one,
and texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, queries, secret_scan, simhash
from .common import shared_path
from .queries import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus labels stay; texts that are null, empty or without a letter go. Equal texts are judged alike."""
    rest = [c for c in docs.columns if c != "text"]
    found = langid.identify(docs, keep=(*rest, "text"))
    return found.where(F.col("lang_pred") != langid.UND).select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies (equal words, or shingles of five words with a similarity of 0.8) the smallest doc_id stays.

    Rows that repeat a doc_id stay together: the decision is about ids. A row with a null id, or whose text has no
    words, always stays.
    """
    found = simhash.near_copies(docs, width=5, similarity=0.8).where(F.col("id") != F.col("component")).select(F.col("id").alias("dropped")).distinct()
    return docs.join(found, docs.doc_id == found.dropped, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, by id: rows that repeat such an id go with it. Null ids and null or empty texts stay."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("dropped")).distinct()
    return docs.join(found, docs.doc_id == found.dropped, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced, and n_chars follows its new text. A null text stays null."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = secret_scan.scan(docs, keep=tuple(rest))
    changed = {"doc_id": F.col("id"), "text": F.col("redacted")} | {c: F.col(f"keep_{c}") for c in rest}
    if "n_chars" in changed:
        changed["n_chars"] = F.when(F.col("spans") == "", F.col("keep_n_chars")).otherwise(F.length("redacted")).cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[changed[c].alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; a null text is an empty one."""
    return bpe.encode_decode(docs, queries.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language id", known_language),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("bpe encoding and decoding", encode),
]

#: No stage before the last can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = shared_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise ValueError("no stages")
