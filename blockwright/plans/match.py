"""Labels, digest matches, chains, budgets and covered time over orders, lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import US, micros
from ..operators import match
from .common import RECORDINGS, recordings, table

DAY = 86_400 * US


def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    """Lines as frames at places order * 1000 + line * 40, clusters of 16,000; slots from every second cluster's customers."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 40).alias("offset"), micros(F.col("l_shipdate")).alias("t"))
    orders = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") * 1000 / 16_000).cast("bigint").alias("cluster"), (F.col("o_custkey") % 7).alias("channel"), micros(F.col("o_orderdate")).alias("t"))
    slots = orders.where("cluster % 2 = 0").groupBy("cluster").agg(F.min("channel").alias("channel"), F.min("t").alias("start"), F.max("t").alias("end"))
    return match.cluster_label(li, slots, "offset", 0, 16_000, F.col("t"), 30 * DAY).groupBy("label").agg(F.count("*").alias("frames"))


def _streams(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    t = micros(F.col("o_orderdate"))
    index = o.where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 500).alias("block"), (F.col("o_custkey") % 9).alias("channel"), t.alias("start"), (t + 60 * DAY).alias("end"), F.col("o_orderkey").alias("at"))
    streams = o.where("o_orderkey % 3 = 1").select("o_orderkey", (F.col("o_custkey") % 600).alias("blk"), t.alias("a"), (t + 2 * DAY).alias("z"))
    return streams, index


def range_labels(spark, d) -> DataFrame:
    streams, index = _streams(spark, d)
    return match.range_label(streams, index, "blk", "a", "z", DAY).select("o_orderkey", "label")


def majority_labels(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return match.majority_label(li, "l_orderkey", "l_returnflag", "n").withColumn("frames", F.col("frames").cast("bigint"))


def _pieces(spark, d, odd: int) -> DataFrame:
    """Lines of text as pieces of a source; sources are halves of the documents."""
    docs = table(spark, d, "documents").where(F.col("doc_id") % 2 == odd)
    lines = docs.select(F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("source", "pos", F.sha2("line", 256).alias("digest"), F.octet_length("line").alias("length"))


def digest_matches(spark, d) -> DataFrame:
    return match.digest_matches(_pieces(spark, d, 0), _pieces(spark, d, 1), 20)


def verdicts(spark, d) -> DataFrame:
    """Pieces of each even source that some odd source holds, their share, and the verdict (25 pieces make a finding)."""
    ours, theirs = _pieces(spark, d, 0), _pieces(spark, d, 1).where("length >= 20").select("digest").distinct()
    hit = ours.join(theirs.withColumn("hit", F.lit(1)), "digest", "left").groupBy("source").agg(F.count("*").alias("pieces"), F.count("hit").alias("matched"))
    verdict = F.when(F.col("matched") == F.col("pieces"), "identical").when(F.col("matched") > 0, "partial").otherwise("none")
    return hit.select("source", "pieces", "matched", F.bround(F.col("matched") / F.col("pieces"), 6).alias("share"), verdict.alias("verdict"), (F.col("matched") >= 25).alias("meets_criterion"))


def longest_chains(spark, d) -> DataFrame:
    """Per user, the longest run of events whose values rise in the order of time."""
    ev = table(spark, d, "events").select("user_id", "event_id", (F.col("value") * 100).cast("bigint").alias("v"))
    return match.longest_chains(ev, "user_id", "event_id", "v")


def credited(spark, d) -> DataFrame:
    """Each part goes to the supplier with the most lines of it."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return match.credited(li, "l_partkey", "l_suppkey")


def budget(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return match.within_budget(docs, "doc_id", "n_chars", 100_000, 256)


def first_differences(spark, d) -> DataFrame:
    """Lines of neighbouring orders held together place by place."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("v"))
    side = lambda odd: li.where(F.col("l_orderkey") % 2 == odd).select(F.floor(F.col("l_orderkey") / 2).cast("bigint").alias("pair"), "l_linenumber", "v")
    return match.first_difference(side(0), side(1), "pair", "l_linenumber", "v")


def covered_time(spark, d) -> DataFrame:
    """Time of each camera's sessions that other footage of the same camera covers: sessions against merged recordings of odd users."""
    from ..operators import intervals

    rec = recordings(spark, d)
    a = intervals.merged(rec.where("user_id % 2 = 0"), ["camera"], "s", "e", "event_id", 0).select(F.col("camera").alias("key"), "s", "e")
    b = intervals.merged(rec.where("user_id % 2 = 1"), ["camera"], "s", "e", "event_id", 0).select(F.col("camera").alias("key"), F.col("s").alias("bs"), F.col("e").alias("be"))
    return match.covered(a, b, 3600 * US)


def listing_check(spark, d) -> DataFrame:
    """Observed against expected files: missing, unlisted, or with another size or time."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("size"), micros(F.col("o_orderdate")).alias("t"))
    seen = o.where("file % 11 <> 4").select("file", (F.col("size") + F.when(F.col("file") % 13 == 0, 1).otherwise(0)).alias("size"), (F.col("t") + F.when(F.col("file") % 17 == 0, 3 * US).otherwise(0)).alias("t"))
    seen = seen.unionByName(seen.where("file % 97 = 0").withColumn("file", F.col("file") + 10_000_000))
    a, b = o.select("file", F.col("size").alias("s1"), F.col("t").alias("t1")), seen.select(F.col("file").alias("f2"), F.col("size").alias("s2"), F.col("t").alias("t2"))
    both = a.join(b, F.col("file") == F.col("f2"), "full_outer")
    state = F.when(F.col("f2").isNull(), "missing").when(F.col("file").isNull(), "unlisted").when(F.col("s1") != F.col("s2"), "size").when(F.abs(F.col("t1") - F.col("t2")) > US, "time")
    return both.select(F.coalesce("file", "f2").alias("file"), state.alias("state")).where("state is not null")


def parameter_sets(spark, d) -> DataFrame:
    """Values in both, only in the first, only in the second: nations of customers with debts and of suppliers."""
    a = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda df, name: df.withColumn("part", F.lit(name))
    return tag(a.intersect(b), "in_both").unionByName(tag(a.subtract(b), "only_first")).unionByName(tag(b.subtract(a), "only_second"))


_PIECES = "l AS (SELECT doc_id AS source, k - 1 AS pos, string_split(text, chr(10))[k] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(k)), p AS (SELECT source, CAST(pos AS INTEGER) AS pos, sha256(line) AS digest, strlen(line) AS length FROM l)"

QUERIES = {
    "j1_cluster_labels": cluster_labels, "j3_range_labels": range_labels, "j15_majority_labels": majority_labels, "j12_digest_matches": digest_matches, "a40_v12_match_verdicts": verdicts,
    "o11_longest_chains": longest_chains, "o13_credited": credited, "t7_budget": budget, "j16_first_differences": first_differences, "j17_covered_time": covered_time, "j14_listing_check": listing_check, "u2_u3_j26_parameter_sets": parameter_sets,
}

ORACLE_SQL = {
    "j1_cluster_labels": f"""WITH f AS (SELECT (l_orderkey * 1000 + l_linenumber * 40) // 16000 AS cluster, epoch_us(l_shipdate) AS t FROM lineitem),
        s AS (SELECT o_orderkey * 1000 // 16000 AS cluster, min(o_custkey % 7) AS channel, min(epoch_us(o_orderdate)) AS a, max(epoch_us(o_orderdate)) AS b FROM orders GROUP BY 1 HAVING cluster % 2 = 0)
        SELECT CASE WHEN t BETWEEN a - {30 * DAY} AND b + {30 * DAY} THEN 'CH' || lpad(channel::VARCHAR, 2, '0') ELSE 'outside_index' END AS label, count(*) AS frames FROM f LEFT JOIN s USING (cluster) GROUP BY 1""",
    "j3_range_labels": f"""WITH i AS (SELECT o_custkey % 500 AS block, o_custkey % 9 AS channel, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + {60 * DAY} AS b, o_orderkey AS at_ FROM orders WHERE o_orderkey % 3 = 0),
        s AS (SELECT o_orderkey, o_custkey % 600 AS block, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + {2 * DAY} AS z FROM orders WHERE o_orderkey % 3 = 1),
        m AS (SELECT o_orderkey, arg_min(channel, (i.a, at_)) AS channel FROM s JOIN i ON i.block = s.block AND i.a - {DAY} <= s.a AND s.z <= i.b + {DAY} GROUP BY 1), e AS (SELECT block, min(a) AS first FROM i GROUP BY 1)
        SELECT s.o_orderkey, CASE WHEN channel IS NOT NULL THEN 'CH' || lpad(channel::VARCHAR, 2, '0') WHEN z < first - {DAY} THEN 'stale_tail' ELSE 'outside_index' END AS label FROM s LEFT JOIN m USING (o_orderkey) LEFT JOIN e USING (block)""",
    "j15_majority_labels": "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, max(n) AS m, CAST(sum(n) AS BIGINT) AS frames, arg_min(l_returnflag, (-n, l_returnflag)) AS l FROM c GROUP BY 1) SELECT l_orderkey, CASE WHEN m >= 0.9::DOUBLE * frames THEN l ELSE 'mixed-evidence' END AS label, frames FROM b",
    "j12_digest_matches": f"WITH {_PIECES}, o AS (SELECT source % 2 AS odd, digest, count(*) AS n, min(source) AS source, min(pos) AS pos FROM p WHERE length >= 20 GROUP BY 1, 2 HAVING n = 1) SELECT a.source, a.pos, b.source AS other, b.pos AS other_pos FROM o a JOIN o b ON a.digest = b.digest AND a.odd = 0 AND b.odd = 1",
    "a40_v12_match_verdicts": f"WITH {_PIECES}, t AS (SELECT DISTINCT digest FROM p WHERE source % 2 = 1 AND length >= 20), g AS (SELECT source, count(*) AS pieces, count(t.digest) AS matched FROM p LEFT JOIN t USING (digest) WHERE source % 2 = 0 GROUP BY 1) SELECT source, pieces, matched, round_even(matched::DOUBLE / pieces, 6) AS share, CASE WHEN matched = pieces THEN 'identical' WHEN matched > 0 THEN 'partial' ELSE 'none' END AS verdict, matched >= 25 AS meets_criterion FROM g",
    "o13_credited": "WITH n AS (SELECT l_suppkey, l_partkey, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem)) SELECT l_partkey, arg_min(l_suppkey, (-n, l_suppkey)) AS l_suppkey FROM n GROUP BY 1",
    "t7_budget": "WITH r AS (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) AS BIGINT) AS total FROM documents) SELECT * FROM r WHERE doc_id < (SELECT coalesce(min(doc_id), 9223372036854775807) FROM r WHERE total > 100000)",
    "j16_first_differences": "WITH l AS (SELECT l_orderkey // 2 AS pair, l_orderkey % 2 AS odd, l_linenumber, max(l_returnflag) AS v FROM lineitem GROUP BY ALL), j AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.l_linenumber, b.l_linenumber) AS k, a.v AS x, b.v AS y FROM (FROM l WHERE odd = 0) a FULL JOIN (FROM l WHERE odd = 1) b ON a.pair = b.pair AND a.l_linenumber = b.l_linenumber) SELECT pair, count(*) AS compared, min(k) FILTER (WHERE x IS DISTINCT FROM y) AS first_at FROM j GROUP BY 1",
    "j17_covered_time": f"WITH {RECORDINGS}, q AS (SELECT *, user_id % 2 AS odd, max(e) OVER (PARTITION BY camera, user_id % 2 ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rec), r AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY camera, odd ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS k FROM q), m AS (SELECT camera, odd, min(s) AS s, max(e) AS e FROM r GROUP BY camera, odd, k) SELECT a.camera AS key, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS covered FROM m a JOIN m b ON a.camera = b.camera AND a.odd = 0 AND b.odd = 1 AND a.s < b.e AND a.e > b.s GROUP BY 1",
    "j14_listing_check": f"WITH o AS (SELECT o_orderkey AS file, o_custkey AS size, epoch_us(o_orderdate) AS t FROM orders), s AS (SELECT file, size + (file % 13 = 0)::INT AS size, t + CASE WHEN file % 17 = 0 THEN {3 * US} ELSE 0 END AS t FROM o WHERE file % 11 <> 4), s2 AS (FROM s UNION ALL SELECT file + 10000000, size, t FROM s WHERE file % 97 = 0), j AS (SELECT coalesce(o.file, s2.file) AS file, CASE WHEN s2.file IS NULL THEN 'missing' WHEN o.file IS NULL THEN 'unlisted' WHEN o.size <> s2.size THEN 'size' WHEN abs(o.t - s2.t) > {US} THEN 'time' END AS state FROM o FULL JOIN s2 ON o.file = s2.file) SELECT * FROM j WHERE state IS NOT NULL",
    "u2_u3_j26_parameter_sets": "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k, 'in_both' AS part FROM (FROM a INTERSECT FROM b) UNION ALL SELECT k, 'only_first' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT k, 'only_second' FROM (FROM b EXCEPT FROM a)",
}
