"""Matching of footage and labels: range labels, majority labels, digest matches, longest chains, byte-budget selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def cluster_label(frames: DataFrame, slots: DataFrame, offset: str, base: int, size: int, date: Column, slack: int) -> DataFrame:
    """Frames with the label of the index slot whose cluster holds them and whose dates, widened by ``slack``, hold their own; else outside_index. Slots: (cluster, channel, start, end)."""
    at = frames.withColumn("cluster", F.floor((F.col(offset) - base) / size).cast("bigint"))
    joined = at.join(slots.select("cluster", "channel", F.col("start").alias("_a"), F.col("end").alias("_b")), "cluster", "left")
    inside = date.between(F.col("_a") - slack, F.col("_b") + slack)
    label = F.when(inside, F.concat(F.lit("CH"), F.lpad(F.col("channel").cast("string"), 2, "0"))).otherwise("outside_index")
    return joined.withColumn("label", label).drop("_a", "_b", "channel")


def range_label(streams: DataFrame, index: DataFrame, block: str, start: str, end: str, slack: int, width: int | None = None) -> DataFrame:
    """(stream columns, label): the first record, by start then place, of the same block whose span holds the stream; stale_tail before the block's earliest record; else outside_index.

    ``index`` has (block, channel, start, end, at). Records and streams meet by buckets of time, each stream in the
    bucket of its own start alone, so neither a block with many records nor its streams are held together.
    """
    width = width or max(1, 64 * slack)
    bucket = lambda c: F.floor(c / width).cast("bigint")
    asked = streams.select(F.col(block).alias("_b"), F.col(start).alias("_a"), F.col(end).alias("_z")).distinct()
    spans = index.select(F.col("block").alias("_rb"), "channel", (F.col("start") - slack).alias("_s"), (F.col("end") + slack).alias("_e"), "start", "at").where("_e >= _s")
    spans = spans.withColumn("_rk", F.explode(F.sequence(bucket(F.col("_s")), bucket(F.col("_e")))))
    fits = asked.join(spans, (F.col("_b") == F.col("_rb")) & (bucket(F.col("_a")) == F.col("_rk")) & (F.col("_s") <= F.col("_a")) & (F.col("_z") <= F.col("_e")))
    first = fits.groupBy(F.col("_b").alias("_fb"), F.col("_a").alias("_fa"), F.col("_z").alias("_fz")).agg(F.min_by("channel", F.struct("start", "at")).alias("_c"))
    earliest = index.groupBy(F.col("block").alias("_eb")).agg(F.min("start").alias("_first"))
    joined = streams.join(first, (F.col(block) == F.col("_fb")) & (F.col(start) == F.col("_fa")) & (F.col(end) == F.col("_fz")), "left").join(earliest, F.col(block) == F.col("_eb"), "left")
    label = F.when(F.col("_c").isNotNull(), F.concat(F.lit("CH"), F.lpad(F.col("_c").cast("string"), 2, "0")))
    label = label.when(F.col(end) < F.col("_first") - slack, "stale_tail").otherwise("outside_index")
    return joined.withColumn("label", label).drop("_fb", "_fa", "_fz", "_c", "_eb", "_first")


def majority_label(tallies: DataFrame, stream: str, label: str, n: str, share: float = 0.9) -> DataFrame:
    """(stream, label): the commonest label if it has ``share`` of the frames, else mixed-evidence; ties: the smallest label."""
    counts = tallies.groupBy(stream, label).agg(F.sum(n).alias("_n"))
    by = counts.groupBy(stream).agg(F.max("_n").alias("_m"), F.sum("_n").alias("_all"), F.min_by(label, F.struct((-F.col("_n")).alias("a"), F.col(label).alias("b"))).alias("_l"))
    return by.select(stream, F.when(F.col("_m") >= share * F.col("_all"), F.col("_l")).otherwise("mixed-evidence").alias("label"), F.col("_all").alias("frames"))


def digest_matches(ours: DataFrame, theirs: DataFrame, least: int) -> DataFrame:
    """(source, pos, other, other_pos) of pieces with equal digests that occur once on either side and have ``least`` bytes. Tables: (source, pos, digest, length)."""
    once = lambda df: df.where(F.col("length") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("source").alias("source"), F.min("pos").alias("pos")).where("n = 1")
    a, b = once(ours), once(theirs)
    return a.join(b.select("digest", F.col("source").alias("other"), F.col("pos").alias("other_pos")), "digest").select("source", "pos", "other", "other_pos")


def increasing_chain(values) -> list[int]:
    """Indexes of a longest strictly increasing subsequence.

    The length of the longest one that ends at each value comes from a sorted array of the smallest last values; the
    chain is then picked from the back, one value of each length.
    """
    values = np.asarray(values)
    smallest = np.full(len(values), np.iinfo(np.int64).max)
    length = np.zeros(len(values), np.int64)
    for k, v in enumerate(values.tolist()):
        length[k] = np.searchsorted(smallest, v) + 1
        smallest[length[k] - 1] = v
    chain: list[int] = []
    want, below = int(length.max(initial=0)), np.inf
    for k in range(len(values) - 1, -1, -1):
        if length[k] == want and values[k] < below:
            chain.append(k)
            want, below = want - 1, values[k]
    return chain[::-1]


def longest_chains(anchors: DataFrame, source: str, pos: str, other_pos: str) -> DataFrame:
    """(source, anchors, chain) for each source: how many anchors stand in the same order on both sides. A source is one file."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "anchors": [len(pdf)], "chain": [len(increasing_chain(pdf["o"].tolist()))]})

    rows = anchors.select(F.col(source).cast("bigint").alias("source"), F.col(pos).cast("bigint").alias("p"), F.col(other_pos).cast("bigint").alias("o"))
    return rows.groupBy("source").applyInPandas(run, "source bigint, anchors bigint, chain bigint")


def credited(matches: DataFrame, piece: str, source: str) -> DataFrame:
    """Each piece goes to the source with the most matches; ties: the smallest source."""
    totals = matches.groupBy(source).agg(F.count("*").alias("_n"))
    return matches.join(totals, source).groupBy(piece).agg(F.min_by(source, F.struct((-F.col("_n")).alias("a"), F.col(source).alias("b"))).alias(source))


def within_budget(df: DataFrame, order: str, size: str, most: int, stretch: int) -> DataFrame:
    """Rows in order until the first that would take the running total over ``most``; none after it. Totals are made in two steps."""
    at = df.withColumn("_s", F.floor(F.col(order) / stretch).cast("bigint"))
    w = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
    base = at.groupBy("_s").agg(F.sum(size).alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = at.join(base, "_s").withColumn("total", F.sum(size).over(inside) + F.col("_base"))
    stop = run.where(F.col("total") > most).agg(F.min(order).alias("_stop"))
    return run.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_s", "_base", "_stop")


def first_difference(a: DataFrame, b: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, compared, first_at): two sequences held together place by place, and the first place where they differ (also: one of them ends)."""
    x, y = a.select(key, pos, F.col(value).alias("_x")), b.select(key, pos, F.col(value).alias("_y"))
    both = x.join(y, [key, pos], "full_outer")
    return both.groupBy(key).agg(F.count("*").alias("compared"), F.min(F.when(~F.col("_x").eqNullSafe(F.col("_y")), F.col(pos))).alias("first_at"))


def covered(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(key, covered): how much of each key's intervals (s, e) of ``a`` the intervals of ``b`` (bs, be) of the same key cover; each side's own are disjoint."""
    pairs = intervals.overlap_join(a, b.withColumnRenamed("key", "_key"), "s", "e", "bs", "be", width).where(F.col("key") == F.col("_key"))
    return pairs.groupBy("key").agg(F.sum(F.least("e", "be") - F.greatest("s", "bs")).alias("covered"))


def positional_fill(chain: DataFrame, export: DataFrame, recovered: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """(source, i, g): the anchors, and every other piece found equal where its neighbouring anchors say that it should be.

    ``chain`` (source, i, g) are anchors in order on both sides, ``export`` (source, i, digest) all pieces of a source,
    ``recovered`` (g, digest) the other side. A place counts from the anchor before, else from the one after; it must
    lie between both and is used once, by the first piece. Last, what is out of order is left out.
    """
    anchors = chain.select("source", F.col("i").alias("ai"), F.col("g").alias("ag"))
    rest = export.join(chain.select("source", "i"), ["source", "i"], "left_anti")
    before = intervals.asof_join(rest, anchors, ["source"], "i", "ai", ["ai", "ag"], stretch=stretch).withColumnsRenamed({"ai": "bi", "ag": "bg"})
    both = intervals.asof_join(before, anchors, ["source"], "i", "ai", ["ai", "ag"], forward=True, stretch=stretch)
    guesses = F.array(F.struct(F.lit(1).alias("turn"), (F.col("bg") + F.col("i") - F.col("bi")).alias("g")), F.struct(F.lit(2).alias("turn"), (F.col("ag") - F.col("ai") + F.col("i")).alias("g")))
    between = (F.col("g") > F.coalesce("bg", F.lit(-1))) & (F.col("ag").isNull() | (F.col("g") < F.col("ag")))
    tried = both.withColumn("_x", F.explode(guesses)).select("source", "i", "digest", "bg", "ag", "_x.turn", "_x.g").where(F.col("g").isNotNull() & between)
    found = tried.join(recovered.select("g", F.col("digest").alias("_d")), "g").where(F.col("digest") == F.col("_d")).select("source", F.coalesce("bg", F.lit(-1)).alias("bg"), "i", "turn", "g")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Between two anchors, piece by piece: the first of its places that is still free."""
        used: dict[int, int] = {}
        done: set[int] = set()
        for i, g in zip(*(pdf.sort_values(["i", "turn"])[c].tolist() for c in ("i", "g"))):
            if i not in done and g not in used:
                used[g] = i
                done.add(i)
        return pd.DataFrame({"source": pdf["source"].iloc[0], "i": list(used.values()), "g": list(used)})

    filled = found.groupBy("source", "bg").applyInPandas(settle, "source bigint, i bigint, g bigint")
    every = chain.select(F.col("source").cast("bigint"), F.col("i").cast("bigint"), F.col("g").cast("bigint")).unionByName(filled)
    top = intervals.running_max(every, ["source"], "i", [], F.col("g"), "_top", stretch=stretch)
    return top.where(F.col("_top").isNull() | (F.col("g") > F.col("_top"))).drop("_top")


def ranges(rows: DataFrame, lanes: list[str], number: str, stretch: int = 1 << 16) -> DataFrame:
    """(lanes, first, last): whole numbers as ranges of neighbours; repeated numbers count once."""
    one = rows.select(*lanes, number).distinct()
    run = intervals.running_max(one, lanes, number, [], F.col(number), "_before", stretch=stretch)
    opens = F.when(F.col("_before").isNull() | (F.col(number) > F.col("_before") + 1), F.col(number))
    run = intervals.running_max(run, lanes, number, [], opens, "_run", inclusive=True, stretch=stretch)
    return run.groupBy(*lanes, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def cross_reference(frames: DataFrame, pieces: DataFrame, slots: DataFrame, base: int, size: int, date: Column, slack: int = 5, share: float = 0.9, stretch: int = 1 << 26) -> DataFrame:
    """(volume, sid, label, frames, share): streams named by the index slots of the clusters that their frames lie in.

    ``pieces`` (volume, sid, offset, length) hold the streams' footage; each frame goes to the piece it lies in, takes
    its cluster's label if its date fits, and a stream has the label of ``share`` of its frames, else mixed-evidence.
    """
    at = pieces.where("length > 0").select("volume", F.col("offset").alias("_at"), F.col("length").alias("_len"), "sid")
    own = intervals.asof_join(frames, at, ["volume"], "offset", "_at", ["_at", "_len", "sid"], stretch=stretch).where(F.col("offset") < F.col("_at") + F.col("_len"))
    tally = cluster_label(own, slots, "offset", base, size, date, slack).groupBy("volume", "sid", "label").agg(F.count("*").alias("n"))
    by = tally.groupBy("volume", "sid").agg(F.max("n").alias("_m"), F.sum("n").alias("frames"), F.min_by("label", F.struct((-F.col("n")).alias("a"), F.col("label").alias("b"))).alias("_l"))
    return by.select("volume", "sid", F.when(F.col("_m") >= share * F.col("frames"), F.col("_l")).otherwise("mixed-evidence").alias("label"), "frames", F.bround(F.col("_m") / F.col("frames"), 4).alias("share"))
