"""Further findings: coverage of an index, summaries, calibration, checks between sources, switches, graph export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import US, micros
from ..operators import daylight, findings, intervals
from .common import RECORDINGS, recordings, table

DAY, HOUR = 86_400 * US, 3600 * US


def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of an index (customers' orders) with recorded time, first and last, and the share that footage (their lines) recovers."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("block"), "o_orderkey", micros(F.col("o_orderdate")).alias("t"))
    got = findings.index_coverage(o, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "block", "o_orderkey", "t")
    return got.select("block", "records", F.col("first").alias("first_us"), F.col("last").alias("last_us"), "recovered", F.bround("share", 4).alias("recovered_share"))


def log_summary(spark, d) -> DataFrame:
    """Records by kind with first, last and the newest one's place."""
    return findings.log_summary(recordings(spark, d), "camera", "s", "event_id").withColumnsRenamed({"first": "first_us", "last": "last_us"})


def band_calibration(spark, d) -> DataFrame:
    """The band with the best mean of its streams' mean scores, if it is a half or more: labels as bands, clips as streams."""
    e = table(spark, d, "embeddings").select((F.col("label") % 4).alias("band"), (F.col("vec_id") % 20).alias("stream"), (F.col("vec_id") * 37 % 101).alias("score"))
    return findings.best_band(e, "band", "stream", "score", 50)


def clock_tally(spark, d) -> DataFrame:
    """Readings of each user's clock against the container's: counts, and least, greatest and upper median offset in seconds."""
    off = F.floor((F.col("e") - F.col("s")) / US).cast("bigint") - 50
    return findings.clock_tally(recordings(spark, d).withColumn("off", off), "user_id", "off", 3)


def totals(spark, d) -> DataFrame:
    """Totals over all recorders."""
    o = table(spark, d, "orders").select("o_custkey", micros(F.col("o_orderdate")).alias("t"), F.floor("o_totalprice").cast("bigint").alias("size"))
    return findings.totals(o, "o_custkey", "t", "t", "size").withColumnsRenamed({"first": "first_us", "last": "last_us"})


def stage_status(spark, d) -> DataFrame:
    """State of each stage of a case from the artefacts that exist: order priorities as artefacts, states as stages."""
    o = findings.stage_states(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F", "O"], ["O"], 5)
    return o.groupBy("state").agg(F.count("*").alias("cases"))


def picture_runs(spark, d) -> DataFrame:
    """Runs of neighbouring frames that touch, are near in time and have one picture size."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_linenumber").alias("size"), F.min(micros(F.col("l_shipdate"))).alias("t"))
    return findings.picture_runs(li, "l_suppkey", "l_orderkey", "t", "size", 100, 900 * DAY, 1 << 14)


def light_switches(spark, d) -> DataFrame:
    """Changes between colour and infra-red that last three readings and are no further apart than thirty days, with the middle of the change."""
    rec = recordings(spark, d)
    infrared = (F.col("user_id") % 4 == 0) | (F.floor(F.col("s") / (20 * DAY)) % 2 == 0)
    return daylight.light_switches(rec, "camera", "s", ["event_id"], infrared, gap=30 * DAY)


def model_checks(spark, d) -> DataFrame:
    """Stated against found: agree, differ, or not determined where one side is silent."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 5).alias("stated"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") % 5).alias("found"))
    both = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy(findings.compared(F.col("stated"), F.col("found")).alias("verdict")).agg(F.count("*").alias("n"))


def master_checks(spark, d) -> DataFrame:
    """Fields of each record against the others; null where a check cannot be made."""
    checks = {"price is within bounds": F.col("l_extendedprice") >= F.col("l_quantity"), "discount below tax ceiling": F.col("l_discount") <= 0.1, "returned lines are finished": F.when(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")}
    return findings.checked(table(spark, d, "lineitem"), checks)


def default_clock(spark, d) -> DataFrame:
    """Footage dated at a clock's default: the first three days of the table stand for the year 2000."""
    rec = recordings(spark, d)
    first = rec.agg(F.min("s").alias("f"))
    return findings.at_default_clock(rec.crossJoin(F.broadcast(first)), "camera", "s", F.col("f") + 3 * DAY)


def statement_coverage(spark, d) -> DataFrame:
    """Files of a statement against those found: by digest; covered, altered (same name, other digest) or not stated."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    stated = docs.where("doc_id % 5 <> 0").withColumn("h", F.when(F.col("doc_id") % 11 == 0, F.lit("x")).otherwise(F.col("h")))
    return findings.statement_states(docs, stated, "doc_id", "h").groupBy("state").agg(F.count("*").alias("files"), F.min("doc_id").alias("first"))


def whole_drive_hashes(spark, d) -> DataFrame:
    """Hashes that may be called whole: only where their length is the device's size."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.length("text").cast("bigint").alias("seen"), F.sha2("text", 256).alias("sha256"))
    docs = docs.withColumn("seen", F.when(F.col("doc_id") % 9 == 0, F.col("seen") - 1).otherwise(F.col("seen")))
    return findings.whole_only(docs, "seen", "n_chars").select("doc_id", "sha256")


def labelled_thumbs(spark, d) -> DataFrame:
    """Pictures with the labels seen at their clip and time."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("clip"), F.floor(F.col("vec_id") / 60).cast("bigint").alias("t"), (F.col("label") % 5).alias("label"))
    return findings.with_labels_seen(e.drop("label"), e.where("label > 0"), ["clip", "t"], "label").select("vec_id", "clip", "t", "labels")


def earlier_runs(spark, d) -> DataFrame:
    """Files whose content an earlier entry of the ledger already names: the first such entry."""
    return findings.earlier_entries(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


def begin_records(spark, d) -> DataFrame:
    """A channel's first log record against its first frame: how far apart, per user."""
    rec = recordings(spark, d)
    return findings.first_apart(rec.where("camera = 'signup'"), rec.where("camera = 'view'"), "user_id", "s").withColumnRenamed("apart", "off_us")


def unlisted(spark, d) -> DataFrame:
    """Index and files held together: listed but absent, present but unlisted, or with another header."""
    o = table(spark, d, "orders").where("o_orderkey % 8 <> 1").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("header"))
    li = table(spark, d, "lineitem").where("l_orderkey % 8 <> 2").groupBy(F.col("l_orderkey").alias("k")).agg((F.min("l_suppkey") % 3).alias("header"))
    return findings.held_together(o, li, "k", "header").groupBy("state").agg(F.count("*").alias("files"))


def event_cameras(spark, d) -> DataFrame:
    """The camera of each event: its own, else its zone's, else unknown."""
    rec = recordings(spark, d).select("event_id", "user_id", (F.col("user_id") % 25).alias("zone"))
    own = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("CH"), F.col("c_nationkey").cast("string")).alias("camera"))
    zones = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("zone"), F.concat(F.lit("Z"), F.col("n_regionkey").cast("string")).alias("camera"))
    return findings.placed_events(rec, own, zones, "user_id", "zone", "camera").groupBy(F.col("placed").alias("camera")).agg(F.count("*").alias("events"))


def frequent_heads(spark, d) -> DataFrame:
    """The twenty commonest words, with the first eight places of each."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "w")).where("w <> ''")
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(20)
    found = words.join(F.broadcast(top), "w")
    local = Window.partitionBy("w", "_t").orderBy("doc_id", "at")
    some = found.withColumn("_t", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("_r", F.row_number().over(local)).where("_r <= 8")
    whole = Window.partitionBy("w").orderBy("doc_id", "at")
    return some.withColumn("rank", F.row_number().over(whole)).where("rank <= 8").select("w", "n", "rank", "doc_id", "at")


#: Name space of identifiers (fixed value).
SPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def name_uuid(name: Column, space: str = SPACE) -> Column:
    """The version-5 UUID of a name, as a URN: it depends on the name alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)))


def graph(spark, d) -> DataFrame:
    """Nodes of a linked-data export, a recorder for every customer: identifiers that depend on the content alone, with links to the nations that they are part of."""
    node = F.to_json(F.struct(name_uuid(F.concat(F.lit("recorder/"), F.col("c_custkey").cast("string"))).alias("@id"), F.lit("Recorder").alias("@type"), F.col("c_name").alias("name"), F.struct(name_uuid(F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"))).alias("@id")).alias("partOf")))
    return table(spark, d, "customer").select("c_custkey", node.alias("node"))


def lost_intervals(spark, d) -> DataFrame:
    """Time that no recorder covers: gaps of the union of all recordings longer than five minutes."""
    rec = recordings(spark, d).withColumn("lane", F.lit("all"))
    return intervals.gaps(rec, "lane", "s", "e", "event_id", 300 * US).select("gap_start", "gap_end")


_SWITCH = f"""WITH {RECORDINGS}, i AS (SELECT *, user_id % 4 = 0 OR (s // {20 * DAY}) % 2 = 0 AS ir FROM rec), p AS (SELECT *, lag(ir) OVER (PARTITION BY camera ORDER BY s, event_id) AS pir FROM i),
    r AS (SELECT *, sum(CASE WHEN pir IS NULL OR pir <> ir THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY s, event_id) AS k FROM p), g AS (SELECT camera, k, count(*) AS n, min(s) AS a, max(s) AS b, bool_or(ir) AS ir FROM r GROUP BY 1, 2),
    f AS (SELECT *, n >= 3 OR row_number() OVER (PARTITION BY camera ORDER BY a) = 1 AS firm FROM g), l AS (SELECT *, last_value(CASE WHEN firm THEN ir END IGNORE NULLS) OVER (PARTITION BY camera ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM f),
    o AS (SELECT *, sum(CASE WHEN firm AND (before_ IS NULL OR before_ <> ir) THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY a) AS m FROM l), h AS (SELECT camera, m, sum(n) AS n, min(a) AS a, max(b) AS b, arg_min(ir, a) AS ir FROM o GROUP BY 1, 2),
    q AS (SELECT *, lag(b) OVER w AS pb, lag(n) OVER w AS pn FROM h WINDOW w AS (PARTITION BY camera ORDER BY a))"""

_UUID = "'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"

QUERIES = {
    "a15_index_coverage": index_coverage, "a18_log_summary": log_summary, "a27_band_calibration": band_calibration, "a28_clock_tally": clock_tally, "a36_totals": totals, "a37_stage_status": stage_status,
    "w12_picture_runs": picture_runs, "w16_light_switches": light_switches, "v1_model_checks": model_checks, "v3_master_checks": master_checks, "v5_default_clock": default_clock, "v11_statement_coverage": statement_coverage,
    "v9_whole_drive_hashes": whole_drive_hashes, "j20_labelled_thumbs": labelled_thumbs, "j21_earlier_runs": earlier_runs, "j22_begin_records": begin_records, "j23_unlisted": unlisted, "j24_event_cameras": event_cameras,
    "t4_t5_frequent_heads": frequent_heads, "s18_graph": graph, "w3_lost_intervals": lost_intervals,
}

ORACLE_SQL = {
    "a15_index_coverage": "SELECT o_custkey % 200 AS block, count(*) AS records, min(epoch_us(o_orderdate)) AS first_us, max(epoch_us(o_orderdate)) AS last_us, count(l_orderkey) AS recovered, round_even(count(l_orderkey)::DOUBLE / count(*), 4) AS recovered_share FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1",
    "a18_log_summary": f"WITH {RECORDINGS} SELECT camera, count(*) AS n, min(s) AS first_us, max(s) AS last_us, arg_max(event_id, (s, event_id)) AS newest FROM rec GROUP BY 1",
    "a27_band_calibration": "WITH m AS (SELECT label % 4 AS band, avg(vec_id * 37 % 101) AS m FROM embeddings GROUP BY label % 4, vec_id % 20), b AS (SELECT band, round_even(avg(m), 6) AS score FROM m GROUP BY 1) SELECT CASE WHEN max(score) >= 50 THEN arg_min(band, (-score, band)) END AS band, max(score) AS score FROM b",
    "a28_clock_tally": f"WITH {RECORDINGS}, o AS (SELECT user_id, (e - s) // {US} - 50 AS off FROM rec) SELECT user_id, count(*) AS n, min(off) AS least, max(off) AS most, list_sort(list(off))[count(*) // 2 + 1] AS median, count(*) FILTER (WHERE abs(off) <= 3) AS agree FROM o GROUP BY 1",
    "a36_totals": "SELECT count(*) AS recordings, count(DISTINCT o_custkey) AS recorders, min(epoch_us(o_orderdate)) AS first_us, max(epoch_us(o_orderdate)) AS last_us, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders",
    "a37_stage_status": "WITH c AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN f AND o THEN 'complete' WHEN o THEN 'running' WHEN n >= 5 THEN 'stalled' ELSE 'waiting' END AS state, count(*) AS cases FROM c GROUP BY 1",
    "w12_picture_runs": f"WITH l AS (SELECT l_suppkey, l_orderkey, max(l_linenumber) AS size, min(epoch_us(l_shipdate)) AS t FROM lineitem GROUP BY 1, 2), p AS (SELECT *, lag(l_orderkey) OVER w AS po, lag(size) OVER w AS ps, lag(t) OVER w AS pt FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey)), r AS (SELECT *, sum(CASE WHEN po IS NULL OR l_orderkey - po > 100 OR abs(t - pt) > {900 * DAY} OR size <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS k FROM p) SELECT l_suppkey, min(l_orderkey) AS run, count(*) AS frames, max(l_orderkey) AS last FROM r GROUP BY l_suppkey, k",
    "w16_light_switches": _SWITCH + f" SELECT camera, CASE WHEN ir THEN 'dusk' ELSE 'dawn' END AS kind, pb + (a - pb) // 2 AS at_us, (a - pb) // 2 AS uncertainty_us FROM q WHERE n >= 3 AND pn >= 3 AND a - pb <= {30 * DAY}",
    "v1_model_checks": "WITH o AS (SELECT o_custkey, count(*) % 5 AS found FROM orders GROUP BY 1), b AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 END AS stated, found FROM customer LEFT JOIN o ON c_custkey = o_custkey) SELECT CASE WHEN stated IS NULL OR found IS NULL THEN 'not determined' WHEN stated = found THEN 'agree' ELSE 'differ' END AS verdict, count(*) AS n FROM b GROUP BY 1",
    "v3_master_checks": "WITH c AS (SELECT 'price is within bounds' AS \"check\", l_extendedprice >= l_quantity AS ok FROM lineitem UNION ALL SELECT 'discount below tax ceiling', l_discount <= 0.1::DOUBLE FROM lineitem UNION ALL SELECT 'returned lines are finished', CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'F' END FROM lineitem) SELECT \"check\", count(*) FILTER (WHERE ok) AS holds, count(*) FILTER (WHERE NOT ok) AS fails, count(*) FILTER (WHERE ok IS NULL) AS unknown FROM c GROUP BY 1",
    "v5_default_clock": f"WITH {RECORDINGS} SELECT camera, count(*) AS at_default FROM rec WHERE s <= (SELECT min(s) FROM rec) + {3 * DAY} GROUP BY 1",
    "v11_statement_coverage": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'not stated' WHEN doc_id % 11 <> 0 THEN 'covered' ELSE 'altered' END AS state, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY 1",
    "v9_whole_drive_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE length(text) - CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END = n_chars",
    "j20_labelled_thumbs": "WITH e AS (SELECT vec_id, vec_id % 20 AS clip, vec_id // 60 AS t, label % 5 AS label FROM embeddings), s AS (SELECT clip, t, string_agg(label::VARCHAR, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT clip, t, label FROM e WHERE label > 0) GROUP BY 1, 2) SELECT vec_id, clip, t, coalesce(labels, '') AS labels FROM e LEFT JOIN s USING (clip, t)",
    "j21_earlier_runs": "WITH w AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT * FROM w WHERE doc_id > first",
    "j22_begin_records": f"WITH {RECORDINGS} SELECT user_id, min(s) FILTER (WHERE camera = 'view') - min(s) FILTER (WHERE camera = 'signup') AS off_us FROM rec GROUP BY 1 HAVING off_us IS NOT NULL",
    "j23_unlisted": "WITH o AS (FROM orders WHERE o_orderkey % 8 <> 1), l AS (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem WHERE l_orderkey % 8 <> 2 GROUP BY 1) SELECT CASE WHEN l_orderkey IS NULL THEN 'absent' WHEN o_orderkey IS NULL THEN 'unlisted' WHEN o_custkey % 3 = s % 3 THEN 'equal' ELSE 'differs' END AS state, count(*) AS files FROM o FULL JOIN l ON o_orderkey = l_orderkey GROUP BY 1",
    "j24_event_cameras": "WITH c AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey % 2 = 0) SELECT CASE WHEN c_nationkey IS NOT NULL THEN 'CH' || c_nationkey WHEN n_regionkey IS NOT NULL THEN 'Z' || n_regionkey ELSE 'UNKNOWN' END AS camera, count(*) AS events FROM events LEFT JOIN c ON user_id = c_custkey LEFT JOIN n ON user_id % 25 = n_nationkey GROUP BY 1",
    "t4_t5_frequent_heads": "WITH w AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS at_, string_split(text, ' ')[k] AS w FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) AS t(k)), c AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1 ORDER BY n DESC, w LIMIT 20) SELECT w, n, CAST(row_number() OVER (PARTITION BY w ORDER BY doc_id, at_) AS INTEGER) AS rank, doc_id, at_ AS \"at\" FROM w JOIN c USING (w) QUALIFY rank <= 8",
    "s18_graph": f"WITH h AS (SELECT c_custkey, c_name, sha1(unhex('{SPACE.replace('-', '')}') || ('recorder/' || c_custkey)::BLOB) AS a, sha1(unhex('{SPACE.replace('-', '')}') || ('nation/' || c_nationkey)::BLOB) AS b FROM customer) SELECT c_custkey, '{{\"@id\":\"' || {_UUID.replace('(h,', '(a,')} || '\",\"@type\":\"Recorder\",\"name\":\"' || c_name || '\",\"partOf\":{{\"@id\":\"' || {_UUID.replace('(h,', '(b,')} || '\"}}}}' AS node FROM h",
    "w3_lost_intervals": f"WITH {RECORDINGS}, q AS (SELECT *, max(e) OVER (ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rec) SELECT pe AS gap_start, s AS gap_end FROM q WHERE s - pe > {300 * US}",
}
