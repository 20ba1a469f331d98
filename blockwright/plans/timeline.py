"""Timeline queries over the event table (type as camera, value as length in seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import US
from ..operators import intervals, timeline
from .common import RECORDINGS, recordings

MINUTE, HOUR = 60 * US, 3600 * US
_RUN = f"WITH {RECORDINGS}, run AS (SELECT *, max(e) OVER (PARTITION BY camera ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rec)"
_GAPS = _RUN + ", gaps AS (SELECT camera, pe AS gap_start, s AS gap_end FROM run WHERE s - pe > {over})"
_SHARED = _GAPS.format(over=HOUR) + """, n AS (SELECT count(DISTINCT camera) AS cameras FROM rec),
    sw AS (SELECT g.camera, g.gap_start, g.gap_end, count(DISTINCT h.camera) AS shared_with FROM gaps g
        LEFT JOIN gaps h ON h.camera <> g.camera AND h.gap_start < g.gap_end AND h.gap_end > g.gap_start GROUP BY ALL),
    shared AS (SELECT sw.*, cameras > 1 AND shared_with = cameras - 1 AS system_wide FROM sw, n)"""
_MERGED = f"WITH {RECORDINGS}" + f""", run AS (SELECT *, max(e) OVER (ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rec),
    flagged AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {MINUTE} THEN 1 ELSE 0 END) OVER (ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM run),
    merged AS (SELECT min(s) AS s, max(e) AS e, count(*) AS members FROM flagged GROUP BY island)"""
_SILENCES = _MERGED + ", silences AS (SELECT e AS a, lead(s) OVER (ORDER BY s) AS b FROM merged QUALIFY b IS NOT NULL)"


def _gaps(spark, d, over) -> DataFrame:
    return intervals.gaps(recordings(spark, d), "camera", "s", "e", "event_id", over)


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d, MINUTE).withColumn("gap_us", F.col("gap_end") - F.col("gap_start"))


def overlap_anomalies(spark, d) -> DataFrame:
    return intervals.overlaps(recordings(spark, d), "camera", "s", "e", "event_id", MINUTE).select("event_id", "camera", "s", "running_end")


def coverage(spark, d) -> DataFrame:
    return timeline.coverage(recordings(spark, d), _gaps(spark, d, MINUTE))


def merged(spark, d) -> DataFrame:
    rec = recordings(spark, d).withColumn("lane", F.lit("all"))
    return intervals.merged(rec, ["lane"], "s", "e", "event_id", MINUTE).drop("lane")


def silences(spark, d) -> DataFrame:
    """Complement of the merged recordings: what no camera covers."""
    rec = recordings(spark, d).withColumn("lane", F.lit("all"))
    return intervals.gaps(rec, "lane", "s", "e", "event_id", MINUTE).select(F.col("gap_start").alias("a"), F.col("gap_end").alias("b"))


def shared_gaps(spark, d) -> DataFrame:
    rec = recordings(spark, d)
    return timeline.shared_gaps(_gaps(spark, d, HOUR), rec)


def system_wide_minutes(spark, d) -> DataFrame:
    return timeline.first_of_minute(shared_gaps(spark, d))


def recurring(spark, d) -> DataFrame:
    return timeline.recurring(_gaps(spark, d, HOUR))


def unindexed_in_gap(spark, d) -> DataFrame:
    """Errors as footage outside the index, held against the gaps of the other cameras."""
    rec = recordings(spark, d)
    loose = rec.where("camera = 'error'").select(F.col("event_id").alias("loose_id"), F.col("s").alias("us"), F.col("e").alias("ue"))
    found = _gaps(spark, d, HOUR).where("camera <> 'error'")
    pairs = intervals.overlap_join(found, loose, "gap_start", "gap_end", "us", "ue", HOUR, strict=False)
    return pairs.groupBy("camera", "gap_start", "gap_end").agg(F.count("*").alias("loose"), F.min("loose_id").alias("first_loose"))


def explained(spark, d) -> DataFrame:
    at = lambda kind: recordings(spark, d).where(F.col("camera") == kind).select(F.col("s").alias("t"))
    return timeline.explained_silences(silences(spark, d).withColumnsRenamed({"a": "s", "b": "e"}), at("signup"), at("error"))


def log_shift(spark, d) -> DataFrame:
    rec = recordings(spark, d)
    return timeline.log_shift(rec.where("camera = 'signup'").select(F.col("s").alias("t")), rec.where("camera = 'purchase'"))


def log_verdict(spark, d) -> DataFrame:
    return timeline.shift_verdict(log_shift(spark, d))


def disagreement(spark, d) -> DataFrame:
    """Index and frame times that differ by more than five seconds: an event's own time and that of its user's previous event, on a common day's clock."""
    rec = recordings(spark, d)
    prior = intervals.running_max(rec, ["user_id"], "s", ["event_id"], F.col("s"), "frame_us")
    off = (F.col("s") - F.col("frame_us"))
    return prior.where(off > 5 * US).select("event_id", "frame_us", off.alias("off_us"), (off > 86_400 * US).alias("over_a_day"))


def late_dated(spark, d) -> DataFrame:
    """Footage dated more than a day after the newest start of the index (the purchases)."""
    rec = recordings(spark, d)
    newest = rec.where("camera = 'purchase' and event_id % 2 = 0").agg((F.max("s") - 5 * 86_400 * US).alias("newest"))
    return rec.crossJoin(F.broadcast(newest)).where(F.col("s") > F.col("newest") + 86_400 * US).select("event_id", "camera", "s")


def union_events(spark, d) -> DataFrame:
    """Indexed, remnant and unindexed footage in one table by the union rules of labels."""
    rec = recordings(spark, d)
    label = F.when(F.col("event_id") % 3 == 0, "CH01").when(F.col("event_id") % 3 == 1, "stale_tail").otherwise("outside_index")
    carved = rec.where("camera in ('view', 'click')").withColumn("label", label)
    kind = F.when(F.col("label").startswith("CH"), "indexed").when(F.col("label") == "stale_tail", "remnant").otherwise("unindexed")
    sure = F.when(F.col("label").startswith("CH"), 0.7).otherwise(0.5)
    own = rec.where("camera not in ('view', 'click')").select("event_id", "camera", "s", "e", F.lit("indexed").alias("kind"), F.lit(0.95).alias("confidence"))
    both = own.unionByName(carved.select("event_id", "camera", "s", "e", kind.alias("kind"), sure.alias("confidence")))
    return both.groupBy("camera", "kind").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"), F.min("s").alias("first_us"), F.max("e").alias("last_us"))


QUERIES = {
    "w1_coverage_gaps": coverage_gaps, "w2_overlaps": overlap_anomalies, "a14_coverage": coverage, "w3_merged": merged, "w3_silences": silences,
    "j4_w4_shared_gaps": shared_gaps, "w5_system_wide_minutes": system_wide_minutes, "a17_recurring": recurring, "j5_unindexed_in_gap": unindexed_in_gap,
    "j6_j7_v7_explained_silences": explained, "j8_log_shift": log_shift, "v8_log_verdict": log_verdict, "v4_disagreement": disagreement,
    "v6_late_dated": late_dated, "u1_a16_union_events": union_events,
}

ORACLE_SQL = {
    "w1_coverage_gaps": _GAPS.format(over=MINUTE) + " SELECT *, gap_end - gap_start AS gap_us FROM gaps",
    "w2_overlaps": _RUN + f" SELECT event_id, camera, s, pe AS running_end FROM run WHERE s < pe - {MINUTE}",
    "a14_coverage": _GAPS.format(over=MINUTE) + """, n AS (SELECT camera, count(*) AS gaps FROM gaps GROUP BY 1)
        SELECT r.camera, count(*) AS recordings, min(s) AS first_us, max(e) AS last_us, CAST(sum(e - s) AS BIGINT) AS covered_us, coalesce(any_value(n.gaps), 0) AS gaps FROM rec r LEFT JOIN n USING (camera) GROUP BY 1""",
    "w3_merged": _MERGED + " SELECT * FROM merged",
    "w3_silences": _SILENCES + " SELECT * FROM silences",
    "j4_w4_shared_gaps": _SHARED + " SELECT * FROM shared",
    "w5_system_wide_minutes": _SHARED + f" SELECT camera, gap_start, gap_end FROM shared WHERE system_wide QUALIFY row_number() OVER (PARTITION BY gap_start // {MINUTE} ORDER BY camera, gap_start, gap_end) = 1",
    "a17_recurring": _GAPS.format(over=HOUR) + f" SELECT camera, (gap_start % {24 * HOUR}) // {10 * MINUTE} AS stretch, count(DISTINCT gap_start // {24 * HOUR}) AS days, count(*) AS times FROM gaps GROUP BY 1, 2 HAVING days >= 3",
    "j5_unindexed_in_gap": _GAPS.format(over=HOUR) + " SELECT g.camera, gap_start, gap_end, count(*) AS loose, min(event_id) AS first_loose FROM gaps g JOIN rec u ON u.camera = 'error' AND g.camera <> 'error' AND gap_start <= u.e AND gap_end >= u.s GROUP BY 1, 2, 3",
    "j6_j7_v7_explained_silences": _SILENCES + f""", ons AS (SELECT a, b, (SELECT min(s) FROM rec WHERE camera = 'signup' AND s >= a AND s <= b + {30 * US}) AS on_us FROM silences),
        offs AS (SELECT *, (SELECT max(s) FROM rec WHERE camera = 'error' AND s <= on_us AND s >= on_us - {900 * US}) AS off_us FROM ons)
        SELECT a, b, on_us, off_us, CASE WHEN on_us IS NULL THEN 'silence_not_in_log' WHEN off_us IS NOT NULL THEN 'power_cut' ELSE 'restart' END AS verdict FROM offs""",
    "j8_log_shift": f"WITH {RECORDINGS}, k AS (SELECT unnest(range(-840, 841, 30)) AS shift_min), p AS (SELECT s AS n FROM rec WHERE camera = 'purchase'), o AS (SELECT CAST(shift_min AS INTEGER) AS shift_min, s + shift_min * {MINUTE} AS tt FROM rec, k WHERE camera = 'signup')"
    f" SELECT shift_min, count(*) AS power_ons, count(*) FILTER (WHERE n - tt <= {120 * US}) AS followed FROM o ASOF LEFT JOIN p ON o.tt <= p.n GROUP BY 1",
    "v8_log_verdict": f"WITH {RECORDINGS}, k AS (SELECT unnest(range(-840, 841, 30)) AS shift_min), p AS (SELECT s AS n FROM rec WHERE camera = 'purchase'), o AS (SELECT CAST(shift_min AS INTEGER) AS shift_min, s + shift_min * {MINUTE} AS tt FROM rec, k WHERE camera = 'signup'),"
    f" c AS (SELECT shift_min, count(*) FILTER (WHERE n - tt <= {120 * US}) AS followed FROM o ASOF LEFT JOIN p ON o.tt <= p.n GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY followed DESC, shift_min) AS k FROM c),"
    " t AS (SELECT max(followed) FILTER (WHERE k = 1) AS best, max(followed) FILTER (WHERE k = 2) AS runner_up, max(shift_min) FILTER (WHERE k = 1) AS sm FROM r)"
    " SELECT best, runner_up, CASE WHEN best >= 5 AND best >= 3 * greatest(runner_up, 1) THEN sm END AS shift_min, CASE WHEN best >= 5 AND best >= 3 * greatest(runner_up, 1) THEN 'determined' ELSE 'not determined' END AS verdict FROM t",
    "v4_disagreement": f"WITH {RECORDINGS}, r AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS frame_us FROM rec) SELECT event_id, frame_us, s - frame_us AS off_us, s - frame_us > {86_400 * US} AS over_a_day FROM r WHERE s - frame_us > {5 * US}",
    "v6_late_dated": f"WITH {RECORDINGS}, n AS (SELECT max(s) - {5 * 86_400 * US} AS newest FROM rec WHERE camera = 'purchase' AND event_id % 2 = 0) SELECT event_id, camera, s FROM rec, n WHERE s > newest + {86_400 * US}",
    "u1_a16_union_events": f"""WITH {RECORDINGS}, k AS (SELECT *, camera NOT IN ('view', 'click') OR event_id % 3 = 0 AS idx, camera NOT IN ('view', 'click') AS own FROM rec),
        l AS (SELECT *, CASE WHEN idx THEN 'indexed' WHEN event_id % 3 = 1 THEN 'remnant' ELSE 'unindexed' END AS kind, CAST(CASE WHEN own THEN 0.95 WHEN idx THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM k)
        SELECT camera, kind, count(*) AS n, min(confidence) AS confidence, min(s) AS first_us, max(e) AS last_us FROM l GROUP BY 1, 2""",
}
