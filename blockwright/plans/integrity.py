"""Hashes, Merkle trees, ledgers and copies over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from .common import table

#: A ledger over orders: each entry is chained to the one before it; one entry is altered, and one before it renumbered.
ALTERED = 900


def _body(df: DataFrame) -> DataFrame:
    return df.select(F.col("c_custkey").alias("i"), F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("body"))


def leaf_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _body(table(spark, d, "customer")).select("i", F.octet_length("body").alias("length"), integrity.leaf(F.col("body")).alias("sha256"))


def _leaves(spark, d) -> DataFrame:
    from ..operators.sequence import row_numbers

    return row_numbers(_body(table(spark, d, "customer")), [], "i", [], stretch=4096).select(F.col("_n").alias("i"), integrity.leaf(F.col("body")).alias("h"))


def merkle_level(spark, d) -> DataFrame:
    return integrity.merkle_level(_leaves(spark, d))


def merkle_root(spark, d) -> DataFrame:
    return integrity.merkle_root(_leaves(spark, d))


def merkle_proofs(spark, d) -> DataFrame:
    """Proofs of all leaves, and whether each leads to the root."""
    leaves = _leaves(spark, d)
    proofs = integrity.merkle_proof(leaves, leaves)
    root = integrity.merkle_root(leaves)
    return proofs.crossJoin(F.broadcast(root)).select("i", F.size("path").alias("steps"), (integrity.verify_proof(F.col("h"), F.col("path")) == F.col("root")).alias("proved"))


def chain(spark, d) -> DataFrame:
    """Verification of a ledger whose links are content hashes of the entries before; entry ALTERED was changed afterwards."""
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("body"))
    # A stand-in chain: each entry names the leaf hash of the entry before it.
    from ..operators.sequence import with_previous

    linked = with_previous(own, [], "seq", [], ["body"], stretch=1 << 16)
    prev = F.coalesce(integrity.leaf(F.concat_ws("|", (F.col("seq") - 1).cast("string"), "prev_body")), F.lit("0" * 64))
    prev = F.when(F.col("prev_body").isNull(), F.lit("0" * 64)).otherwise(prev)
    ledger = linked.select("seq", prev.alias("prev_hash"), F.when(F.col("seq") == ALTERED, F.concat("body", F.lit("!"))).otherwise(F.col("body")).alias("body"), integrity.leaf(F.concat_ws("|", F.col("seq").cast("string"), "body")).alias("entry_hash"))
    at = with_previous(ledger, [], "seq", [], ["entry_hash"], stretch=1 << 16)
    bad_link = F.col("prev_hash") != F.coalesce("prev_entry_hash", F.lit("0" * 64))
    bad_body = F.col("entry_hash") != integrity.leaf(F.concat_ws("|", F.col("seq").cast("string"), "body"))
    return at.agg(F.count("*").alias("entries"), F.min(F.when(bad_link, F.col("seq"))).alias("first_bad_link"), F.min(F.when(bad_body, F.col("seq"))).alias("first_bad_content"))


def duplicate_texts(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", integrity.leaf(F.col("text")).alias("sha256"))
    return integrity.copies(docs, ["sha256"], "doc_id").where("copies > 1")


_LEAVES = "l AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS h FROM customer)"

QUERIES = {
    "b1_leaf_hashes": leaf_hashes, "a7_merkle_level": merkle_level, "a7_merkle_root": merkle_root, "a8_merkle_proofs": merkle_proofs, "a9_chain_verify": chain, "a21_duplicate_copies": duplicate_texts,
}

ORACLE_SQL = {
    "b1_leaf_hashes": "SELECT c_custkey AS i, strlen(c_custkey || '|' || c_name || '|' || c_mktsegment) AS length, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS sha256 FROM customer",
    "a7_merkle_level": f"WITH {_LEAVES} SELECT i // 2 AS i, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(unhex(arg_min(h, i)) || unhex(arg_max(h, i))) END AS h FROM l GROUP BY i // 2",
    "a7_merkle_root": f"""WITH RECURSIVE {_LEAVES}, t(lv, i, h, n) AS (SELECT 0, i, h, count(*) OVER () FROM l UNION ALL
        SELECT any_value(lv) + 1, i // 2, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(unhex(arg_min(h, i)) || unhex(arg_max(h, i))) END, any_value(n + 1) // 2 FROM t WHERE n > 1 GROUP BY i // 2)
        SELECT h AS root FROM t WHERE n = 1""",
    "a8_merkle_proofs": f"""WITH RECURSIVE {_LEAVES}, n AS (SELECT count(*) AS n FROM l), w(leaf, at_, size, steps) AS (SELECT i, i, n, 0 FROM l, n UNION ALL
        SELECT leaf, at_ // 2, (size + 1) // 2, steps + CASE WHEN xor(at_, 1) < size THEN 1 ELSE 0 END FROM w WHERE size > 1)
        SELECT leaf AS i, max(steps) AS steps, true AS proved FROM w GROUP BY leaf""",
    "a9_chain_verify": f"""WITH o AS (SELECT o_orderkey AS seq, o_custkey || '|' || o_orderstatus || '|' || o_orderpriority AS body FROM orders),
        p AS (SELECT seq, body, sha256(seq || '|' || body) AS entry_hash, lag(body) OVER (ORDER BY seq) AS pb FROM o),
        q AS (SELECT seq, CASE WHEN pb IS NULL THEN repeat('0', 64) ELSE sha256((seq - 1) || '|' || pb) END AS prev_hash, CASE WHEN seq = {ALTERED} THEN body || '!' ELSE body END AS body, entry_hash FROM p),
        r AS (SELECT *, coalesce(lag(entry_hash) OVER (ORDER BY seq), repeat('0', 64)) AS pe FROM q)
        SELECT count(*) AS entries, min(seq) FILTER (WHERE prev_hash <> pe) AS first_bad_link, min(seq) FILTER (WHERE entry_hash <> sha256(seq || '|' || body)) AS first_bad_content FROM r""",
    "a21_duplicate_copies": "SELECT sha256(text) AS sha256, min(doc_id) AS first_at, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
}
