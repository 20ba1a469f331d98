"""Findings over a case's tables: summaries, checks of statements, joins of what was listed and what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import upper_median
from .sequence import stitched

# Summaries ------------------------------------------------------------------------------------------------------------


def index_coverage(records: DataFrame, found: DataFrame, block: str, key: str, time: str) -> DataFrame:
    """(block, records, first, last, recovered, share) of index records (block, key, time) and the keys whose footage was found; a key counts once however often it was found."""
    hit = records.join(found.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    return hit.groupBy(block).agg(F.count("*").alias("records"), F.min(time).alias("first"), F.max(time).alias("last"), F.count("_k").alias("recovered"), (F.count("_k") / F.count("*")).alias("share"))


def log_summary(records: DataFrame, kind: str, time: str, place: str) -> DataFrame:
    """(kind, n, first, last, newest): records of each kind; newest is the place of the last one, the greatest of equal times."""
    return records.groupBy(kind).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.max_by(place, F.struct(time, place)).alias("newest"))


def best_band(scores: DataFrame, band: str, stream: str, score: str, least: float, digits: int = 6) -> DataFrame:
    """One row (band, score): the band whose streams' mean scores have the best mean, smaller bands first; null below ``least``. Each stream weighs the same, however many pictures it has."""
    means = scores.groupBy(band, stream).agg(F.avg(score).alias("_m")).groupBy(band).agg(F.bround(F.avg("_m"), digits).alias("score"))
    top = means.agg(F.min_by(band, F.struct((-F.col("score")).alias("s"), F.col(band).alias("b"))).alias("band"), F.max("score").alias("score"))
    return top.select(F.when(F.col("score") >= least, F.col("band")).alias("band"), "score")


def clock_tally(offsets: DataFrame, lane: str, offset: str, within: int) -> DataFrame:
    """(lane, n, least, most, median, agree) of clock offsets; agree counts those of ``within`` or less either way."""
    return offsets.groupBy(lane).agg(F.count("*").alias("n"), F.min(offset).alias("least"), F.max(offset).alias("most"), upper_median(F.col(offset)).alias("median"), F.count_if(F.abs(F.col(offset)) <= within).alias("agree"))


def totals(recordings: DataFrame, recorder: str, start: str, end: str, size: str) -> DataFrame:
    """One row of totals over all recorders."""
    return recordings.agg(F.count("*").alias("recordings"), F.countDistinct(recorder).alias("recorders"), F.min(start).alias("first"), F.max(end).alias("last"), F.sum(size).alias("bytes"))


def rolled_up(pieces: DataFrame, labels: list[str], stream: str, size: str) -> DataFrame:
    """(labels, streams, frames, bytes) of labelled pieces."""
    return pieces.groupBy(*labels).agg(F.countDistinct(stream).alias("streams"), F.count("*").alias("frames"), F.sum(size).alias("bytes"))


def stage_states(artefacts: DataFrame, case: str, artefact: str, done: list[str], begun: list[str], stalled_at: int) -> DataFrame:
    """(case, state): complete with all ``done`` artefacts, running with all ``begun`` ones, stalled with ``stalled_at`` artefacts or more of other kinds, else waiting."""
    has = artefacts.groupBy(case).agg(F.collect_set(artefact).alias("_has"), F.count("*").alias("_n"))
    every = lambda names: F.size(F.array_intersect("_has", F.array(*map(F.lit, names)))) == len(set(names))
    return has.select(case, F.when(every(done), "complete").when(every(begun), "running").when(F.col("_n") >= stalled_at, "stalled").otherwise("waiting").alias("state"))


def planned_stages(found: DataFrame, sure: Column, streams: Column, least_sure: float, least_streams: int) -> DataFrame:
    """Rows with ``plan``, the stages that an unattended run takes: scan always, parse and carve by what was detected, a timeline after both."""
    parse, carve = sure >= least_sure, streams > least_streams
    return found.withColumn("plan", F.concat_ws("+", F.lit("scan"), F.when(parse, "parse"), F.when(carve, "carve"), F.when(parse & carve, "timeline")))


def members_histogram(rows: DataFrame, group: str, name: str) -> DataFrame:
    """(name, frames): groups by the number of their members."""
    return rows.groupBy(group).agg(F.count("*").alias(name)).groupBy(name).agg(F.count("*").alias("frames"))


def touched_blocks(regions: DataFrame, id_col: str, start: str, end: str, size: int, points: bool = False) -> DataFrame:
    """(block, regions, first_region): blocks that regions touch, each once; a region that ends where it starts touches none.

    With ``points`` such a region touches the block inside which it stands; between two blocks it touches neither.
    """
    first, last = F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size)
    touches = first <= last if points else F.col(end) > F.col(start)
    hit = regions.where(touches).select(id_col, F.explode(F.sequence(first, last)).alias("block"))
    return hit.groupBy("block").agg(F.count("*").alias("regions"), F.min(id_col).alias("first_region"))


def picture_runs(frames: DataFrame, lane: str, order: str, time: str, size: str, apart: int, late: int, stretch: int) -> DataFrame:
    """(lane, run, frames, last): neighbouring frames no further than ``apart`` and ``late`` from the one before, of one picture size."""
    now = F.struct(F.col(order).alias("order"), F.col(size).alias("size"), F.col(time).alias("time"))

    def breaks(row: Column, prev: Column) -> Column:
        far = (row["order"] - prev["order"] > apart) | (F.abs(row["time"] - prev["time"]) > late) | (row["size"] != prev["size"])
        return F.coalesce(far, F.lit(True))

    first, prev = F.col("_prev").isNull(), F.col("_prev")
    measures = {"frames": (F.count("*"), F.sum), "last": (F.max(order), F.max)}
    return stitched(frames, [lane], order, stretch, {"_prev": now}, ~first & breaks(now, prev), first, {"row": now}, breaks(F.col("_row.row"), F.col("_past.row")), "run", measures)


# Checks ---------------------------------------------------------------------------------------------------------------


def compared(stated: Column, found: Column) -> Column:
    """agree, differ, or not determined where one side is silent."""
    return F.when(stated.isNull() | found.isNull(), "not determined").when(stated == found, "agree").otherwise("differ")


def checked(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, holds, fails, unknown): how often each condition holds; a null one could not be checked. One pass for all checks."""
    each = F.array(*[F.struct(F.lit(name).alias("check"), ok.cast("boolean").alias("ok")) for name, ok in checks.items()])
    return rows.select(F.explode(each).alias("c")).groupBy("c.check").agg(F.count_if("c.ok").alias("holds"), F.count_if(~F.col("c.ok")).alias("fails"), F.count_if(F.col("c.ok").isNull()).alias("unknown"))


def at_default_clock(rows: DataFrame, lane: str, time: str, until: Column) -> DataFrame:
    """(lane, at_default): rows dated no later than a clock's default and the days after it, when nobody had set the clock."""
    return rows.where(F.col(time) <= until).groupBy(lane).agg(F.count("*").alias("at_default"))


def statement_states(found: DataFrame, stated: DataFrame, name: str, digest: str) -> DataFrame:
    """Files found with ``state``: covered by the statement, altered (the name is stated with another digest), or not stated. Names are stated once."""
    other = stated.select(F.col(name).alias("_n"), F.col(digest).alias("_d"))
    joined = found.join(other, F.col(name) == F.col("_n"), "left")
    return joined.withColumn("state", F.when(F.col("_n").isNull(), "not stated").when(F.col(digest) == F.col("_d"), "covered").otherwise("altered")).drop("_n", "_d")


def whole_only(hashes: DataFrame, seen: str, size: str) -> DataFrame:
    """Hashes that may be called those of the whole: rows whose length is the device's."""
    return hashes.where(F.col(seen) == F.col(size))


def visible(rows: DataFrame, roles: DataFrame, role: str, rules: dict[str, Column]) -> DataFrame:
    """(role and row) pairs that a role may see by its rule; a role without a rule sees none. ``roles`` is a stated list; rows meet the roles that have a rule."""
    known = roles.where(F.col(role).isin(*rules)) if rules else roles.where("false")
    may = F.lit(False)
    for name, rule in rules.items():
        may = may | ((F.col(role) == name) & rule)
    return rows.crossJoin(F.broadcast(known)).where(may)


# Joins ----------------------------------------------------------------------------------------------------------------


def with_labels_seen(pictures: DataFrame, seen: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Pictures with ``labels``, the different labels seen at the same place and time, in order; none is the empty text."""
    told = seen.groupBy(*keys).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set(label)), lambda x: x.cast("string"))).alias("labels"))
    return pictures.join(told, keys, "left").withColumn("labels", F.coalesce("labels", F.lit("")))


def earlier_entries(files: DataFrame, id_col: str, digest: str) -> DataFrame:
    """(id, first, n): files whose content an earlier entry has, with the first such entry and the number of all."""
    ledger = files.groupBy(F.col(digest).alias("_d")).agg(F.min(id_col).alias("first"), F.count("*").alias("n"))
    return files.join(ledger, F.col(digest) == F.col("_d")).where(F.col(id_col) > F.col("first")).select(id_col, "first", "n")


def first_apart(log: DataFrame, frames: DataFrame, lane: str, time: str) -> DataFrame:
    """(lane, apart): how long after a lane's first log record its first frame is; lanes with both."""
    a = log.groupBy(lane).agg(F.min(time).alias("_logged"))
    return a.join(frames.groupBy(lane).agg(F.min(time).alias("_seen")), lane).select(lane, (F.col("_seen") - F.col("_logged")).alias("apart"))


def held_together(listed: DataFrame, present: DataFrame, key: str, header: str) -> DataFrame:
    """(key, state) of an index and the files that are there: absent, unlisted, equal, or differs by the header. A key stands once on either side."""
    a, b = listed.select(F.col(key).alias("_a"), F.col(header).alias("_ah")), present.select(F.col(key).alias("_b"), F.col(header).alias("_bh"))
    state = F.when(F.col("_b").isNull(), "absent").when(F.col("_a").isNull(), "unlisted").when(F.col("_ah").eqNullSafe(F.col("_bh")), "equal").otherwise("differs")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), state.alias("state"))


def placed_events(events: DataFrame, own: DataFrame, zones: DataFrame, device: str, zone: str, camera: str) -> DataFrame:
    """Events with ``placed``: their device's own camera, else their zone's, else UNKNOWN. ``own`` is (device, camera), ``zones`` (zone, camera), each key once."""
    a, b = own.select(F.col(device).alias("_d"), F.col(camera).alias("_own")), zones.select(F.col(zone).alias("_z"), F.col(camera).alias("_zone"))
    joined = events.join(a, F.col(device) == F.col("_d"), "left").join(b, F.col(zone) == F.col("_z"), "left")
    return joined.withColumn("placed", F.coalesce("_own", "_zone", F.lit("UNKNOWN"))).drop("_d", "_own", "_z", "_zone")
