"""Clocks from daylight: when a camera changes between colour and infra-red, and the offset that puts those changes at one height of the sun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import US, exclusive_quartile, solar_elevation
from . import sequence
from .intervals import STRETCH, running_max

#: Chroma of an infra-red picture at most; readings that a mode must hold; longest gap of a placed change; trial offsets in minutes; plausible heights; trial minutes around the best (fixed values).
MONO_MAX, MIN_RUN, MAX_GAP, OFFSETS, TWILIGHT, AROUND = 4.0, 3, 30 * 60 * US, (-14 * 60, 14 * 60), (-12.0, 10.0), 180


def light_switches(readings: DataFrame, lane: str, t: str, ties: list[str], infrared: Column, least: int = MIN_RUN, gap: int = MAX_GAP, stretch: int = STRETCH) -> DataFrame:
    """(lane, kind, at_us, uncertainty_us): dusk to infra-red and dawn to colour, in the middle of the two readings around, with half their distance as uncertainty.

    A run of fewer than ``least`` readings is no change: it belongs to what stood before it. The first run stands
    whatever its length. Changes over longer gaps than ``gap`` are not placed.
    """
    prev = sequence.with_previous(readings.withColumn("_ir", infrared), [lane], t, ties, ["_ir"], stretch)
    changes = F.coalesce(F.col("_ir") != F.col("prev__ir"), F.lit(True))
    place = F.struct(F.col(t).alias("a"), *[F.col(c).alias(f"tie{k}") for k, c in enumerate(ties)])  # of equal times, runs are told apart by their ties
    run = running_max(prev, [lane], t, ties, F.when(changes, place), "_run", inclusive=True, stretch=stretch)
    one = run.groupBy(lane, "_run").agg(F.count("*").alias("n"), F.max(t).alias("b"), F.bool_or("_ir").alias("ir")).withColumn("a", F.col("_run.a"))
    first = sequence.with_previous(one, [lane], "a", ["_run"], ["n"], stretch)
    firm = (F.col("n") >= least) | F.col("prev_n").isNull()
    last = running_max(first, [lane], "a", ["_run"], F.when(firm, F.struct("_run", "ir")), "_last", stretch=stretch)
    opens = firm & (F.col("_last").isNull() | (F.col("_last.ir") != F.col("ir")))
    kept = running_max(last.withColumn("_opens", opens), [lane], "a", ["_run"], F.when(F.col("_opens"), F.col("a")), "_kept", inclusive=True, stretch=stretch)
    # Runs that begin at one time stand in one mode, and the one that opens it tells its kind.
    at_once = kept.groupBy(lane, "a").agg(F.max("_kept").alias("_kept"), F.sum("n").alias("n"), F.max("b").alias("b"), F.min(F.when(F.col("_opens"), F.struct("_run", "ir")))["ir"].alias("ir"))
    modes = at_once.groupBy(lane, "_kept").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("ir", "a").alias("ir"))
    pair = sequence.with_previous(modes, [lane], "a", [], ["b", "n"], stretch)
    apart = F.col("a") - F.col("prev_b")
    return pair.where((F.col("n") >= least) & (F.col("prev_n") >= least) & (apart <= gap)).select(
        lane, F.when(F.col("ir"), "dusk").otherwise("dawn").alias("kind"), (F.col("prev_b") + F.floor(apart / 2)).cast("bigint").alias("at_us"), F.floor(apart / 2).cast("bigint").alias("uncertainty_us")
    )


def _height(lat: float, lon: float, later: int = 0) -> Column:
    return solar_elevation(F.col("at_us") - F.col("offset_min").cast("bigint") * (60 * US) + later * US, lat, lon)


def clock_offset(switches: DataFrame, lane: str, lat: float, lon: float) -> DataFrame:
    """(lane, offset_min, elevation, spread, events, median, low_quartile, high_quartile, least, most) of each lane.

    The offset (clock less UTC, in minutes) is the one at which all dusks have a sinking sun, all dawns a rising one,
    their mean height is one of twilight, and the heights differ least; ties: the smallest. The other figures are of
    the offsets at which each switch alone meets that height. All are null without both kinds, or if no offset fits.
    """
    lanes = switches.groupBy(lane).agg(F.count("*").alias("events"), F.countDistinct("kind").alias("_kinds"))
    trial = switches.withColumn("offset_min", F.explode(F.sequence(F.lit(OFFSETS[0]), F.lit(OFFSETS[1]))))
    trial = trial.withColumn("h", _height(lat, lon)).withColumn("ok", (F.col("kind") == "dawn") == (_height(lat, lon, 120) > F.col("h")))
    by = trial.groupBy(lane, "offset_min").agg(F.bool_and("ok").alias("ok"), F.avg("h").alias("elevation"), F.stddev_pop("h").alias("spread"))
    fits = by.where(F.col("ok") & F.col("elevation").between(*TWILIGHT)).join(lanes.where("_kinds = 2").select(lane), lane)
    best = fits.groupBy(lane).agg(F.min(F.struct("spread", "offset_min", "elevation")).alias("b")).select(lane, F.col("b.offset_min").alias("best"), F.col("b.elevation").alias("elevation"), F.col("b.spread").alias("spread"))
    near = switches.select(lane, "kind", "at_us").distinct().join(best, lane).withColumn("offset_min", F.explode(F.sequence(F.col("best") - AROUND, F.col("best") + AROUND))).withColumn("off", F.abs(_height(lat, lon) - F.col("elevation")))
    own = near.groupBy(lane, "kind", "at_us").agg(F.min(F.struct("off", "offset_min"))["offset_min"].alias("o"))
    times = switches.groupBy(lane, "kind", "at_us").agg(F.count("*").alias("_n"))
    listed = own.join(times, [lane, "kind", "at_us"]).groupBy(lane).agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat("o", F.col("_n").cast("int"))))).alias("o"))
    n = F.size("o")
    median = (F.element_at("o", F.floor((n + 1) / 2).cast("int")) + F.element_at("o", F.floor(n / 2).cast("int") + 1)) / 2
    quartile = lambda k, other: F.when(n >= 4, exclusive_quartile(F.col("o"), k)).otherwise(F.element_at("o", other).cast("double"))
    told = listed.select(lane, median.alias("median"), quartile(1, 1).alias("low_quartile"), quartile(3, -1).alias("high_quartile"), F.element_at("o", 1).alias("least"), F.element_at("o", -1).alias("most"))
    return lanes.drop("_kinds").join(best.withColumnRenamed("best", "offset_min"), lane, "left").join(told, lane, "left")
