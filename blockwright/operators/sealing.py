"""Sealed blocks: each is encrypted and bound to its place, and a Merkle root stands for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import integrity


def _nonce(package: str):
    """Twelve bytes that no other block of any package of this key has."""
    return F.substring(F.unhex(F.sha2(F.concat(F.lit(f"{package}:"), F.col("index").cast("string")), 256)), 1, 12)


def _bound(package: str):
    """What a block is told to be, in the clear: its package, place and length."""
    return F.concat_ws(":", F.lit(package), F.col("index").cast("string"), F.col("length").cast("string"))


def sealed(blocks: DataFrame, key: bytes, package: str) -> DataFrame:
    """(index, length, sealed, sha256) of blocks (index, content) under AES-256 in GCM, with ``package``'s own nonces; ``package`` must never be used twice with a key."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    told = blocks.select(F.col("index").cast("bigint").alias("index"), F.octet_length("content").cast("bigint").alias("length"), F.col("content").cast("binary").alias("content"))
    shut = F.aes_encrypt("content", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _nonce(package), _bound(package).cast("binary"))
    return told.select("index", "length", shut.alias("sealed")).withColumn("sha256", F.sha2("sealed", 256))


def seal_root(rows: DataFrame) -> DataFrame:
    """(root, blocks) over the ciphertexts, so that a package can be checked without the key."""
    return integrity.merkle_root(rows.select(F.col("index").alias("i"), F.col("sha256").alias("h"))).crossJoin(rows.agg(F.count("*").alias("blocks")))


def seal_breaks(rows: DataFrame) -> DataFrame:
    """(index, reason) of what shows without the key: a block whose bytes differ from their digest, and numbers that occur twice or not at all."""
    changed = rows.where(F.sha2("sealed", 256) != F.col("sha256")).select("index", F.lit("digest").alias("reason"))
    twice = rows.groupBy("index").count().where("count > 1").select("index", F.lit("twice").alias("reason"))
    ends = rows.agg(F.count_distinct("index").alias("n"), F.max("index").alias("top"))
    holes = ends.where("top + 1 <> n").select(F.lit(None).cast("bigint").alias("index"), F.lit("missing").alias("reason"))
    return changed.unionByName(twice).unionByName(holes)


def unsealed(rows: DataFrame, key: bytes, package: str) -> DataFrame:
    """(index, content, ok) again. A block that was changed, moved, taken from another package or sealed with another key has no content and is not ok."""
    opened = F.try_aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _bound(package).cast("binary"))
    moved = F.substring("sealed", 1, 12) != _nonce(package)
    return rows.select("index", F.when(~moved, opened).alias("content"), "length").select("index", "content", F.coalesce(F.octet_length("content") == F.col("length"), F.lit(False)).alias("ok"))
