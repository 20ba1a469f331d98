"""Activity, sessions, runs, counters and decode states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import US
from ..operators import intervals, sequence
from .common import RECORDINGS, recordings, table

HOUR = 3600 * US
CELL = HOUR
_CELLS = f"WITH {RECORDINGS}, cells AS (SELECT camera, s // {CELL} AS cell, CAST(sum(e - s) FILTER (WHERE user_id % 4 <> 0) AS BIGINT) AS p_bytes, count(*) FILTER (WHERE user_id % 4 <> 0) AS p_frames, CAST(coalesce(sum(e - s) FILTER (WHERE user_id % 4 = 0), 0) AS BIGINT) AS i_bytes, count(*) FILTER (WHERE user_id % 4 = 0) AS i_frames FROM rec GROUP BY 1, 2)"
#: Frames that a cell needs to be judged; the table has few events, so the floor is low here.
JUDGED = 1


def cells(spark: SparkSession, d: str) -> DataFrame:
    """P and I bytes and frames per camera and stretch of time; every fourth user's events stand for I frames."""
    rec = recordings(spark, d).withColumn("cell", F.floor(F.col("s") / CELL).cast("bigint"))
    i, size = F.col("user_id") % 4 == 0, F.col("e") - F.col("s")
    return rec.groupBy("camera", "cell").agg(
        F.sum(F.when(~i, size)).alias("p_bytes"), F.count_if(~i).alias("p_frames"), F.coalesce(F.sum(F.when(i, size)), F.lit(0)).alias("i_bytes"), F.count_if(i).alias("i_frames")
    )


def _judged(spark, d) -> DataFrame:
    return cells(spark, d).where(F.col("p_frames") >= JUDGED)


def medians(spark, d) -> DataFrame:
    return sequence.lane_median(_judged(spark, d), "camera", "p_bytes")


def peaks(spark, d) -> DataFrame:
    """Cells with three times the local upper median or more, 30 judged rows either side."""
    local = sequence.local_index(_judged(spark, d), "camera", "cell", "p_bytes", 30)
    index = F.bround(F.col("p_bytes") / F.col("local_median"), 2)
    return local.select("camera", "cell", "p_bytes", "local_median", index.alias("local_index")).where("p_bytes >= 3 * local_median")


def joint_peaks(spark, d) -> DataFrame:
    return peaks(spark, d).groupBy("cell").agg(F.count("*").alias("cameras")).where("cameras > 1")


def sessions(spark, d) -> DataFrame:
    """Runs of a user's events no more than ten days apart."""
    rec = recordings(spark, d)
    prev = sequence.with_previous(rec, ["user_id"], "s", ["event_id"], ["s"])
    run = sequence.runs(prev, ["user_id"], "s", ["event_id"], F.col("s") - F.col("prev_s") > 240 * HOUR, "session")
    return run.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.max("s").alias("last_us"))


def file_joins(spark, d) -> DataFrame:
    """Files of a channel joined where one starts within a minute of the previous end."""
    return intervals.merged(recordings(spark, d), ["camera"], "s", "e", "event_id", 10 * US).where("members > 1")


def _packs(spark, d) -> DataFrame:
    """Lines of an order as packs: numbers as places, with a clock that wraps at 33 bits."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))
    clock = F.pmod(F.lit((1 << 33) - 50_000).cast("bigint") + F.col("l_orderkey") * 7 + F.col("l_linenumber") * 90_000 + F.when(F.col("l_returnflag") == "R", 600_000).otherwise(0), F.lit(1 << 33).cast("bigint"))
    return li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("at"), F.when(F.col("l_quantity") > 45, 2).otherwise(1).cast("bigint").alias("size"), clock.alias("scr"))


def pack_streams(spark, d) -> DataFrame:
    split = sequence.clock_runs(_packs(spark, d), "l_orderkey", "at", "at", "size", "scr", 450_000, stretch=1 << 20)
    return split.groupBy("l_orderkey", "stream").agg(F.count("*").alias("packs"), F.max("at").alias("last_at"), F.sum("size").alias("bytes"))


def extents(spark, d) -> DataFrame:
    """Pieces that touch, made one extent."""
    split = sequence.runs(sequence.with_previous(_packs(spark, d), ["l_orderkey"], "at", [], ["at", "size"], 1 << 20), ["l_orderkey"], "at", [], F.col("prev_at") + F.col("prev_size") != F.col("at"), "start", 1 << 20)
    return split.groupBy("l_orderkey", "start").agg((F.max(F.col("at") + F.col("size")) - F.min("at")).alias("length"), F.count("*").alias("pieces"))


def _counters(spark, d) -> DataFrame:
    """A counter per supplier that now and then repeats."""
    li = table(spark, d, "lineitem")
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), (F.col("l_orderkey") - F.col("l_linenumber") * 40).alias("counter"))


def kept_frames(spark, d) -> DataFrame:
    kept = sequence.not_repeated(_counters(spark, d), ["l_suppkey"], "at", [], "counter", stretch=1 << 14)
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("kept"), F.max("counter").alias("last_counter"))


def completeness(spark, d) -> DataFrame:
    """Missing numbers of a counter, and the confidence that completeness gives, in tenths of a thousandth."""
    miss = sequence.missing_counters(_counters(spark, d), ["l_suppkey"], "counter")
    share = (F.col("span") - F.col("missing")) / F.col("span")
    return miss.select("*", F.floor(F.least(F.lit(0.6), 0.3 + 0.3 * share) * 10_000).cast("bigint").alias("confidence_e4"))


def decode_states(spark, d) -> DataFrame:
    """Turns as frames: the user's turns that a number divides by four are keys; every fifth turn is missing."""
    turns = table(spark, d, "conversations").where("turn % 5 <> 3").select("conv_id", "turn", (F.col("turn") + F.floor(F.col("conv_id") % 3)).cast("bigint").alias("counter"))
    state = sequence.decode_classes(turns, ["conv_id"], "turn", F.col("turn") % 4 == 1, "counter", 1 << 20)
    return state.groupBy("state").agg(F.count("*").alias("n"))


def durations(spark, d) -> DataFrame:
    """Frame durations and the flags of jumps: 0x40 for a break, 0x20 for a step back, upon 0x9F."""
    prev = sequence.with_previous(recordings(spark, d), ["camera"], "event_id", [], ["s"], 1 << 14)
    step = F.col("s") - F.col("prev_s")
    flag = F.lit(0x9F).bitwiseOR(F.when(step > HOUR, 0x40).otherwise(0)).bitwiseOR(F.when(step < 0, 0x20).otherwise(0))
    return prev.select("event_id", step.alias("step_us"), F.when(F.col("prev_s").isNull(), 0x9F).otherwise(flag).alias("flag"))


def zone_mode(spark, d) -> DataFrame:
    """The commonest quarter-hour distance between events of a user and the previous event; ties: the smallest."""
    prev = sequence.with_previous(recordings(spark, d), ["user_id"], "s", ["event_id"], ["s"])
    quarter = F.floor(F.pmod(F.col("s") - F.col("prev_s"), F.lit(24 * HOUR).cast("bigint")) / (HOUR // 4)).cast("bigint")
    counts = prev.where("prev_s is not null").groupBy(quarter.alias("quarter")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "quarter").limit(1)


_PACKS = "p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS at_, CAST(CASE WHEN l_quantity > 45 THEN 2 ELSE 1 END AS BIGINT) AS size, (8589934592 - 50000 + l_orderkey * 7 + l_linenumber * 90000 + CASE WHEN l_returnflag = 'R' THEN 600000 ELSE 0 END) % 8589934592 AS scr FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2))"
_PREV = "q AS (SELECT *, lag(at_) OVER w AS pa, lag(size) OVER w AS ps, lag(scr) OVER w AS pc FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY at_))"
_PEAKS = _CELLS + f""", j AS (SELECT * FROM cells WHERE p_frames >= {JUDGED}), w AS (SELECT *, list_sort(list(p_bytes) OVER (PARTITION BY camera ORDER BY cell ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING)) AS l FROM j),
    m AS (SELECT camera, cell, p_bytes, l[len(l) // 2 + 1] AS local_median FROM w), peaks AS (SELECT *, round_even(p_bytes / local_median, 2) AS local_index FROM m WHERE p_bytes >= 3 * local_median)"""

QUERIES = {
    "a11_activity_cells": cells, "a12_activity_medians": medians, "w15_activity_peaks": peaks, "a13_joint_peaks": joint_peaks, "w10_sessions": sessions,
    "w11_file_joins": file_joins, "w9_pack_streams": pack_streams, "w8_extents": extents, "w22_kept_frames": kept_frames, "a34_a41_completeness": completeness,
    "w17_a33_decode_states": decode_states, "w18_durations": durations, "a19_zone_mode": zone_mode,
}

ORACLE_SQL = {
    "a11_activity_cells": _CELLS + " SELECT * FROM cells",
    "a12_activity_medians": _CELLS + f" SELECT camera, list_sort(list(p_bytes))[count(*) // 2 + 1] AS median, count(*) AS n FROM cells WHERE p_frames >= {JUDGED} GROUP BY 1",
    "w15_activity_peaks": _PEAKS + " SELECT * FROM peaks",
    "a13_joint_peaks": _PEAKS + " SELECT cell, count(*) AS cameras FROM peaks GROUP BY 1 HAVING cameras > 1",
    "w10_sessions": f"WITH {RECORDINGS}, q AS (SELECT *, lag(s) OVER w AS ps FROM rec WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), r AS (SELECT *, sum(CASE WHEN ps IS NULL OR s - ps > {240 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM q) SELECT user_id, min(s) AS session, count(*) AS n, max(s) AS last_us FROM r GROUP BY user_id, k",
    "w11_file_joins": f"WITH {RECORDINGS}, q AS (SELECT *, max(e) OVER (PARTITION BY camera ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM rec), r AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + {10 * US} THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS k FROM q) SELECT camera, min(s) AS s, max(e) AS e, count(*) AS members FROM r GROUP BY camera, k HAVING members > 1",
    "w9_pack_streams": f"WITH {_PACKS}, {_PREV}, r AS (SELECT *, sum(CASE WHEN pa IS NULL OR pa + ps <> at_ OR abs((scr - pc + 4294967296 + 8589934592) % 8589934592 - 4294967296) > 450000 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY at_) AS k FROM q) SELECT l_orderkey, min(at_) AS stream, count(*) AS packs, max(at_) AS last_at, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY l_orderkey, k",
    "w8_extents": f"WITH {_PACKS}, {_PREV}, r AS (SELECT *, sum(CASE WHEN pa IS NULL OR pa + ps <> at_ THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY at_) AS k FROM q) SELECT l_orderkey, min(at_) AS start, max(at_ + size) - min(at_) AS length, count(*) AS pieces FROM r GROUP BY l_orderkey, k",
    "w22_kept_frames": "WITH c AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS at_, l_orderkey - l_linenumber * 40 AS counter FROM lineitem), r AS (SELECT *, max(counter) OVER (PARTITION BY l_suppkey ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM c) SELECT l_suppkey, count(*) AS kept, max(counter) AS last_counter FROM r WHERE top IS NULL OR counter > top GROUP BY 1",
    "a34_a41_completeness": "WITH c AS (SELECT l_suppkey, l_orderkey - l_linenumber * 40 AS counter FROM lineitem), g AS (SELECT l_suppkey, count(*) AS n, max(counter) - min(counter) + 1 AS span, max(counter) - min(counter) + 1 - count(DISTINCT counter) AS missing FROM c GROUP BY 1) SELECT *, CAST(floor(least(0.6::DOUBLE, 0.3::DOUBLE + 0.3::DOUBLE * ((span - missing)::DOUBLE / span)) * 10000) AS BIGINT) AS confidence_e4 FROM g",
    "w17_a33_decode_states": "WITH t AS (SELECT conv_id, turn, turn + conv_id % 3 AS counter FROM conversations WHERE turn % 5 <> 3), p AS (SELECT *, turn % 4 = 1 AS key, counter - lag(counter) OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS gap FROM t), r AS (SELECT *, max(CASE WHEN key THEN turn END) OVER w AS k, max(CASE WHEN gap AND NOT key THEN turn END) OVER w AS g FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT CASE WHEN k IS NULL THEN 'before_key' WHEN g > k THEN 'after_gap' ELSE 'clean' END AS state, count(*) AS n FROM r GROUP BY 1",
    "w18_durations": f"WITH {RECORDINGS}, p AS (SELECT *, s - lag(s) OVER (PARTITION BY camera ORDER BY event_id) AS step_us FROM rec) SELECT event_id, step_us, CAST(159 | CASE WHEN step_us > {HOUR} THEN 64 ELSE 0 END | CASE WHEN step_us < 0 THEN 32 ELSE 0 END AS INTEGER) AS flag FROM p",
    "a19_zone_mode": f"WITH {RECORDINGS}, p AS (SELECT s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS step FROM rec) SELECT (step % {24 * HOUR}) // {HOUR // 4} AS quarter, count(*) AS n FROM p WHERE step IS NOT NULL GROUP BY 1 ORDER BY n DESC, quarter LIMIT 1",
}
