"""Timeline findings: shared and system-wide gaps, recurring interruptions, explained outages, clock shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import US, day_number, ten_minutes
from . import intervals

MINUTE = 60 * US


def coverage(rec: DataFrame, found: DataFrame) -> DataFrame:
    """Per camera: recordings, first start, last end, recorded time, gaps; cameras without a gap have 0."""
    sums = rec.groupBy("camera").agg(F.count("*").alias("recordings"), F.min("s").alias("first_us"), F.max("e").alias("last_us"), F.sum(F.col("e") - F.col("s")).alias("covered_us"))
    counts = found.groupBy("camera").agg(F.count("*").alias("n"))
    return sums.join(counts, "camera", "left").select(*sums.columns, F.coalesce("n", F.lit(0)).alias("gaps"))


def shared_gaps(found: DataFrame, cameras: DataFrame) -> DataFrame:
    """Gaps with the number of other cameras that have an overlapping gap, and whether all of them have (more than one camera)."""
    mine = found.select("camera", "gap_start", "gap_end")
    others = found.select(F.col("camera").alias("other"), F.col("gap_start").alias("os"), F.col("gap_end").alias("oe"))
    # Gaps are short beside a day, so a bucket of an hour holds few of them from each camera.
    pairs = intervals.overlap_join(mine, others, "gap_start", "gap_end", "os", "oe", 60 * MINUTE).where("camera <> other")
    counts = pairs.groupBy("camera", "gap_start", "gap_end").agg(F.countDistinct("other").alias("shared_with"))
    total = cameras.agg(F.countDistinct("camera").alias("cameras"))
    joined = mine.join(counts, ["camera", "gap_start", "gap_end"], "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("shared_with", F.lit(0))
    return joined.select("camera", "gap_start", "gap_end", n.alias("shared_with"), ((F.col("cameras") > 1) & (n == F.col("cameras") - 1)).alias("system_wide"))


def first_of_minute(found: DataFrame) -> DataFrame:
    """Of the system-wide gaps that start in one minute, the first by camera and start."""
    minute = F.floor(F.col("gap_start") / MINUTE).cast("bigint")
    first = Window.partitionBy("_m").orderBy("camera", "gap_start", "gap_end")
    return found.where("system_wide").withColumn("_m", minute).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_m", "_r", "system_wide", "shared_with")


def recurring(found: DataFrame, days: int = 3) -> DataFrame:
    """Ten-minute stretches of the day in which a camera's gaps start on so many distinct days or more."""
    keyed = found.select("camera", ten_minutes(F.col("gap_start")).alias("stretch"), day_number(F.col("gap_start")).alias("day"))
    return keyed.groupBy("camera", "stretch").agg(F.countDistinct("day").alias("days"), F.count("*").alias("times")).where(F.col("days") >= days)


def explained_silences(silences: DataFrame, power_on: DataFrame, shutdown: DataFrame, on_slack: int = 30 * US, off_within: int = 900 * US) -> DataFrame:
    """Silences [a, b] with the first power-on from a to b + 30 s, the latest shutdown up to 900 s before it, and the verdict."""
    on = power_on.select(F.col("t").alias("on_us"))
    off = shutdown.select(F.col("t").alias("off_us"))
    lane = lambda df: df.withColumn("_lane", F.lit(0))
    first = intervals.asof_join(lane(silences.withColumnsRenamed({"s": "a", "e": "b"})), lane(on).withColumn("_on", F.col("on_us")), ["_lane"], "a", "_on", ["on_us"], forward=True)
    first = first.withColumn("on_us", F.when(F.col("on_us") <= F.col("b") + on_slack, F.col("on_us")))
    back = intervals.asof_join(first.withColumn("_q", F.coalesce("on_us", F.lit(-(1 << 60)))), lane(off).withColumn("_off", F.col("off_us")), ["_lane"], "_q", "_off", ["off_us"], within=off_within)
    verdict = F.when(F.col("on_us").isNull(), "silence_not_in_log").when(F.col("off_us").isNotNull(), "power_cut").otherwise("restart")
    return back.select("a", "b", "on_us", F.when(F.col("on_us").isNotNull(), F.col("off_us")).alias("off_us"), verdict.alias("verdict"))


def log_shift(power_on: DataFrame, starts: DataFrame, within: int = 120 * US, span_min: int = 840, step_min: int = 30) -> DataFrame:
    """For each trial shift of the log's clock, how many power-ons a recording follows within two minutes.

    Time is cut into bins of ``within``. A recording that follows lies in the bin of the power-on or in the next one, so
    a bin's last start and the next bin's first one decide: the recordings become one row a bin, and a power-on meets one.
    """
    bin_ = lambda c: F.floor(c / within).cast("bigint")
    ends = starts.where("s is not null").groupBy(bin_(F.col("s")).alias("_b")).agg(F.min("s").alias("first"), F.max("s").alias("last"))
    none = F.lit(None).cast("bigint")
    bins = ends.select("_b", "last", none.alias("next")).unionByName(ends.select((F.col("_b") - 1).alias("_b"), none.alias("last"), F.col("first").alias("next")))
    bins = bins.groupBy("_b").agg(F.max("last").alias("last"), F.max("next").alias("next"))
    times = power_on.groupBy("t").agg(F.count("*").alias("_n"))
    shifts = times.select("t", "_n", F.explode(F.sequence(F.lit(-span_min), F.lit(span_min), F.lit(step_min))).alias("shift_min"))
    moved = shifts.withColumn("at", F.col("t") + F.col("shift_min").cast("bigint") * MINUTE).withColumn("_b", bin_(F.col("at")))
    followed = F.coalesce((F.col("last") >= F.col("at")) | (F.col("next") - F.col("at") <= within), F.lit(False))
    near = moved.join(bins, "_b", "left")
    return near.groupBy("shift_min").agg(F.sum("_n").alias("power_ons"), F.sum(F.when(followed, F.col("_n")).otherwise(0)).alias("followed"))


def shift_verdict(scores: DataFrame, least: int = 5, clear: int = 3) -> DataFrame:
    """The best shift (ties: the earliest) if it has ``least`` hits and ``clear`` times the runner-up's."""
    top = F.array_sort(F.collect_list(F.struct((-F.col("followed")).alias("n"), "shift_min")))  # one row per trial shift
    one = scores.agg(top.alias("top")).select((-F.col("top")[0]["n"]).alias("best"), F.col("top")[0]["shift_min"].alias("shift_min"), (-F.col("top")[1]["n"]).alias("runner_up"))
    clear_win = (F.col("best") >= least) & (F.col("best") >= clear * F.greatest("runner_up", F.lit(1)))
    return one.select("best", "runner_up", F.when(clear_win, F.col("shift_min")).alias("shift_min"), F.when(clear_win, "determined").otherwise("not determined").alias("verdict"))
