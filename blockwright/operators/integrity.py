"""Leaf hashes, Merkle roots with inclusion proofs, and hash-chained ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import with_previous


def leaf(content: Column) -> Column:
    """Lower-case hex SHA-256 of bytes."""
    return F.sha2(content.cast("binary"), 256)


def parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def merkle_level(leaves: DataFrame) -> DataFrame:
    """(i, h) one level up: neighbours are hashed together, a last odd node is handed up as it is."""
    pairs = leaves.groupBy(F.shiftright("i", 1).alias("i")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"), F.count("*").alias("n"))
    return pairs.select("i", F.when(F.col("n") == 1, F.col("a")).otherwise(parent(F.col("a"), F.col("b"))).alias("h"))


def _fold(pairs: Column) -> Column:
    """One level over an ordered array of hashes."""
    half = F.sequence(F.lit(0), F.ceil(F.size(pairs) / 2).cast("int") - 1)
    at = lambda k: F.get(pairs, k)
    return F.transform(half, lambda k: F.when(at(2 * k + 1).isNull(), at(2 * k)).otherwise(parent(at(2 * k), at(2 * k + 1))))


def merkle_root(leaves: DataFrame, width: int = 10) -> DataFrame:
    """(root) of leaves (i, h) with i from 0 without holes; no leaf gives an empty root.

    A pass folds aligned groups of 2**width leaves (the same tree, since a group is a whole subtree), so the passes
    grow with the logarithm of the count to that base. The number of passes follows from one count.
    """
    left = leaves.count()
    level = leaves.select(F.col("i").cast("bigint").alias("i"), "h")
    while left > 1:
        level = level.groupBy(F.shiftright("i", width).alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]).alias("hs"))
        for _ in range(width):
            level = level.withColumn("hs", F.when(F.size("hs") > 1, _fold(F.col("hs"))).otherwise(F.col("hs")))
        level, left = level.select("i", F.col("hs")[0].alias("h")), -(-left // (1 << width))
    return level.agg(F.coalesce(F.min("h"), F.lit("")).alias("root"))


def merkle_proof(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """(i, h, path): for each wanted leaf number the siblings on the way up, with the side they stand on."""
    level = leaves.select(F.col("i").cast("bigint").alias("i"), "h")
    out = wanted.select(F.col("i").cast("bigint").alias("i")).join(level, "i").withColumn("at", F.col("i")).withColumn("path", F.array().cast("array<struct<left:boolean,h:string>>"))
    n = leaves.count()
    while n > 1:
        sibling = level.select(F.col("i").alias("_s"), F.col("h").alias("_h"))
        joined = out.join(sibling, F.col("at").bitwiseXOR(1) == F.col("_s"), "left")
        step = F.array(F.struct((F.col("at") % 2 == 1).alias("left"), F.col("_h").alias("h")))
        out = joined.select("i", "h", F.shiftright("at", 1).alias("at"), F.when(F.col("_s").isNull(), F.col("path")).otherwise(F.concat("path", step)).alias("path"))
        level, n = merkle_level(level), (n + 1) // 2
    return out.drop("at")


def verify_proof(h: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path lead to."""
    return F.aggregate(path, h, lambda acc, x: F.when(x["left"], parent(x["h"], acc)).otherwise(parent(acc, x["h"])))


def entry_hash(seq: Column, prev: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("|", seq.cast("string"), prev, body), 256)


def verify_chain(ledger: DataFrame, seq: str = "seq", prev: str = "prev_hash", body: str = "body", own: str = "entry_hash") -> DataFrame:
    """(entries, first_break, reason) of a ledger: the first entry with a wrong number, link or content."""
    at = with_previous(ledger, [], seq, [], [seq, own], stretch=1 << 20)
    wrong_seq = F.col(seq) != F.coalesce(F.col(f"prev_{seq}") + 1, F.lit(0))
    wrong_link = F.col(prev) != F.coalesce(F.col(f"prev_{own}"), F.lit("0" * 64))
    wrong_body = F.col(own) != entry_hash(F.col(seq), F.col(prev), F.col(body))
    why = F.when(wrong_seq, "sequence").when(wrong_link, "link").when(wrong_body, "content")
    broken = at.select(F.col(seq).alias("seq"), why.alias("why"))
    return broken.agg(F.count("*").alias("entries"), F.min(F.when(F.col("why").isNotNull(), F.col("seq"))).alias("first_break"), F.min_by("why", F.when(F.col("why").isNotNull(), F.col("seq"))).alias("reason"))


def copies(df: DataFrame, keys: list[str], first: str) -> DataFrame:
    """One row for each key: its first place and how many copies there are."""
    return df.groupBy(*keys).agg(F.min(first).alias("first_at"), F.count("*").alias("copies"))
