"""Chains of an index table, followed from all heads at once by pointer doubling.

A link goes from a slot to the next one. ``k`` rounds of joining the table of jumps with itself give jumps of ``2**k``
links, so a chain of n slots takes log2(n) rounds, whatever the number of chains, and no volume or chain is one task.
Loops are found first: jumps twice as long lead to fewer slots as long as some way is open; once they lead to as many,
these are the slots on circles, after log2 of the longest way into one. Circles are cut open, numbered from their smallest slot by the same doubling, and put back behind the way that leads into them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Slots of a volume that are scored together.
BLOCK = 1 << 13


def _doubled(links: DataFrame) -> tuple[list[DataFrame], bool]:
    """Jumps (volume, a, b) of 1, 2, 4 ... links, and whether there are circles: then the last ones lead to their slots alone, and to all of them."""
    levels, ends = [store.once(links)], None
    while True:
        now = levels[-1]
        onward = now.select("volume", F.col("a").alias("b"), F.col("b").alias("_c"))
        longer = store.once(now.join(onward, ["volume", "b"]).select("volume", "a", F.col("_c").alias("b")))
        left = longer.select("volume", "b").distinct().count()
        if not left:
            return levels, False
        levels.append(longer)
        if left == ends:
            return levels, True
        ends = left


def _walked(starts: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(volume, start, place, idx): every slot on the way from each start (volume, start), by jumps of doubling length."""
    rows = starts.select("volume", "start", F.lit(0).cast("bigint").alias("place"), F.col("start").alias("idx"))
    for k, jumps in enumerate(levels):
        more = rows.join(jumps.select("volume", F.col("a").alias("idx"), F.col("b").alias("_b")), ["volume", "idx"])
        rows = store.once(rows.unionByName(more.select("volume", "start", (F.col("place") + (1 << k)).alias("place"), F.col("_b").alias("idx"))))
    return rows


def _circles(links: DataFrame, levels: list[DataFrame], slots: int) -> tuple[DataFrame, DataFrame]:
    """Slots on circles (volume, idx, ring, place, size), places from the ring's smallest slot; and the links that lie on no circle."""
    on = store.once(levels[-1].select("volume", F.col("b").alias("idx")).distinct())
    around = links.join(on.withColumnRenamed("idx", "a"), ["volume", "a"], "left_semi")
    least = store.once(around.select("volume", "a", "b", F.least("a", "b").alias("ring")))
    length = 1
    while length < slots:  # the smallest slot within 1, 2, 4 ... links
        ahead = least.select("volume", F.col("a").alias("b"), F.col("b").alias("_b"), F.col("ring").alias("_r"))
        now = store.once(least.join(ahead, ["volume", "b"]).select("volume", "a", F.col("_b").alias("b"), F.least("ring", "_r").alias("ring")))
        settled = now.select("volume", "a", "ring").exceptAll(least.select("volume", "a", "ring")).isEmpty()
        least, length = now, length * 2
        if settled:
            break
    rings = least.select("volume", "ring").distinct().select("volume", F.col("ring").alias("start"))
    opened = around.join(rings.select("volume", F.col("start").alias("b")), ["volume", "b"], "left_anti").select("volume", "a", "b")
    placed = _walked(rings, _doubled(opened)[0]).withColumnRenamed("start", "ring")
    sizes = placed.groupBy("volume", "ring").agg(F.count("*").alias("size"))
    return store.once(placed.join(sizes, ["volume", "ring"])), links.join(on.withColumnRenamed("idx", "a"), ["volume", "a"], "left_anti")


def chain_places(slots: DataFrame) -> DataFrame:
    """(volume, head, place, idx, looped): the slots of each head's file in order, of an index (volume, idx, kind, next, prev, seq).

    Kind 1 is a head and 2 a continuation; a next of 0 ends the file. The way ends before a slot that is missing or no
    continuation, and where it meets itself. Slots are numbered once in a volume; chains may run into one another.
    """
    kept = slots.select("volume", "idx", "kind", "next")
    to = kept.where("kind = 2").select("volume", F.col("idx").alias("next"))
    links = store.once(kept.where("next <> 0").join(to, ["volume", "next"], "left_semi").select("volume", F.col("idx").alias("a"), F.col("next").alias("b")))
    most = slots.groupBy("volume").count().agg(F.max("count")).first()[0] or 0
    heads = kept.where("kind = 1").select("volume", F.col("idx").alias("start"))
    levels, circling = _doubled(links)
    if not circling:
        return _walked(heads, levels).select("volume", F.col("start").alias("head"), "place", "idx", F.lit(False).alias("looped"))
    rings, straight = _circles(links, levels, most)
    ways = store.once(_walked(heads, _doubled(straight)[0]))
    entry = ways.join(rings.select("volume", "idx", "ring", F.col("place").alias("_at"), "size"), ["volume", "idx"])
    turn = entry.select("volume", "start", "ring", "_at", "size", F.col("place").alias("_way"))
    round_ = turn.join(rings.select("volume", "ring", "idx", F.col("place").alias("_p")), ["volume", "ring"])
    round_ = round_.select("volume", "start", (F.col("_way") + F.pmod(F.col("_p") - F.col("_at"), F.col("size"))).alias("place"), "idx")
    looped = turn.select("volume", "start", F.lit(True).alias("_l"))
    straight_part = ways.join(rings.select("volume", "idx"), ["volume", "idx"], "left_anti")
    both = straight_part.select("volume", "start", "place", "idx").unionByName(round_).join(looped, ["volume", "start"], "left")
    return both.select("volume", F.col("start").alias("head"), "place", "idx", F.coalesce("_l", F.lit(False)).alias("looped"))


def chain_files(slots: DataFrame) -> DataFrame:
    """(volume, head, n, last, ok, note) of each file: a loop, a break, a wrong back link or number, or a count that differs is noted."""
    places = store.once(chain_places(slots))
    facts = slots.select("volume", "idx", "next", "prev", "seq")
    after = slots.where("kind = 2").select("volume", F.col("idx").alias("next"), F.col("prev").alias("_prev"), F.col("seq").alias("_seq"))
    at = places.join(facts, ["volume", "idx"]).join(after, ["volume", "next"], "left")
    wrong = F.col("_seq").isNotNull() & ((F.col("_prev") != F.col("idx")) | (F.col("_seq") != F.col("place") + 1))
    by = at.groupBy("volume", "head").agg(
        F.count("*").alias("n"), F.max(F.struct("place", "idx", "next")).alias("end"), F.bool_or("looped").alias("looped"), F.bool_or(wrong).alias("wrong"), F.max(F.when(F.col("place") == 0, F.col("seq"))).alias("declared"),
    )
    note = (
        F.when(F.col("looped") | ((F.col("end.next") != 0) & (F.col("end.next") == F.col("head"))), "loop").when(F.col("end.next") != 0, "broken link").when(F.col("wrong"), "back link differs")
        .when(F.col("declared") != F.col("n") - 1, "count differs").otherwise("")
    )
    return by.select("volume", "head", "n", F.col("end.idx").alias("last"), (note == "").alias("ok"), note.alias("note"))


def index_chains(slots: DataFrame) -> DataFrame:
    """(volume, head, clusters, ok, note): ``chain_files`` with each file's slots as one array, which is as long as the file."""
    slots = store.once(slots)
    lists = chain_places(slots).groupBy("volume", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "idx"))), lambda x: x["idx"]).alias("clusters"))
    return lists.join(chain_files(slots), ["volume", "head"]).select("volume", "head", "clusters", "ok", "note")


def data_base(heads: DataFrame, marks: DataFrame, size: int, begin: str = "vol_start", early: int = 12, late: int = 2, share: float = 0.8, shifts: int = 3, kept: int = 8) -> DataFrame:
    """Where a volume's slot 0 lies: (volume, base, votes, found, error_s, runner_up_s), by votes and then by time.

    ``heads`` are index slots (volume, idx, start_s, end_s), ``marks`` frames that stand where a slot may begin (volume,
    offset, first_s, last_s: first and last second of the footage from there on), ``begin`` a column of heads with the
    volume's first byte. A mark up to ``early`` seconds after a slot's start (one before) and within ``late`` seconds of
    its span votes for the base that puts the two together. The ``kept`` bases of most votes and their neighbours up to
    ``shifts`` slots away are candidates; each is scored over all slots: how many have footage of their time at their
    place, and how far its ends are from theirs. Of those that find at least ``share`` of the most, the least error wins.

    A mark meets the slots whose seconds share its stretch of a few, and votes are pre-aggregated by base. For scores,
    slots are dealt by blocks of BLOCK numbers, and a mark goes to each block to which some candidate puts it, so no row
    is multiplied by the candidates. A mark without a last second counts, and its error does not. Ties: more votes, then
    the smaller base.
    """
    slots = heads.select("volume", "idx", "start_s", "end_s", F.col(begin).alias("_begin")).where("start_s is not null and end_s is not null")
    stretch = lambda s: F.floor(s / (early + 4)).cast("bigint")
    timed = slots.withColumn("_s", F.explode(F.sequence(stretch(F.col("start_s") - 1), stretch(F.col("start_s") + early))))
    met = marks.withColumn("_s", stretch(F.col("first_s"))).join(timed, ["volume", "_s"]).where(F.col("first_s").between(F.col("start_s") - 1, F.col("start_s") + early))
    met = met.where((F.col("first_s") >= F.col("start_s") - late) & (F.col("first_s") <= F.col("end_s") + late))
    votes = met.withColumn("base", F.col("offset") - F.col("idx") * size).where(F.col("base") >= F.col("_begin")).groupBy("volume", "base").agg(F.count("*").alias("votes"), F.min("_begin").alias("_begin"))
    votes = store.once(votes)
    shifted = _most_voted(votes, kept).select("volume", F.explode(F.sequence(F.lit(-shifts), F.lit(shifts))).alias("_k"), "base", "_begin").select("volume", (F.col("base") + F.col("_k") * size).alias("base"), "_begin")
    candidates = shifted.where(F.col("base") >= F.col("_begin")).select("volume", "base").distinct().join(votes.select("volume", "base", "votes"), ["volume", "base"], "left").fillna(0, ["votes"])
    candidates = store.once(candidates)  # a stated set of at most (2 * shifts + 1) * kept bases a volume
    hits = _hits(slots.select("volume", "idx", "start_s", "end_s"), marks, candidates, size, late).groupBy("volume", "base").agg(F.sum("found").alias("found"), F.sum("error").alias("_e"))
    scored = hits.join(candidates, ["volume", "base"]).select("volume", "base", "found", (F.col("_e") / (2 * F.col("found"))).alias("error_s"), "votes")
    most = scored.groupBy("volume").agg(F.max("found").alias("_m"))
    fit = scored.join(most, "volume").where(F.col("found") >= share * F.col("_m"))
    order = Window.partitionBy("volume").orderBy("error_s", F.desc("votes"), "base")  # at most the candidates of one volume
    best = fit.withColumn("_n", F.row_number().over(order)).withColumn("runner_up_s", F.lead("error_s").over(order))
    return best.where("_n = 1").select("volume", "base", "votes", "found", "error_s", "runner_up_s")


def _hits(slots: DataFrame, marks: DataFrame, candidates: DataFrame, size: int, late: int) -> DataFrame:
    """(volume, base, found, error): for parts of a volume, how many pairs of slot and mark each candidate puts at one place in time, and the seconds by which their ends differ."""
    kind = dict(slots.dtypes)["volume"]
    lists = candidates.groupBy("volume").agg(F.array_sort(F.collect_list(F.col("base").cast("bigint"))).alias("bases"))
    dealt = slots.where("volume is not null").withColumn("block", F.floor(F.col("idx") / BLOCK).cast("bigint"))
    fits = F.filter("bases", lambda b: (F.col("offset") - b) % size == 0)
    at = F.array_distinct(F.transform(fits, lambda b: F.floor((F.col("offset") - b) / (size * BLOCK)).cast("bigint")))
    none = lambda c: F.lit(None).cast("bigint").alias(c)
    met = marks.where("first_s is not null").join(lists, "volume").select("volume", F.explode(at).alias("block"), "offset", "first_s", "last_s")
    told = dealt.select("volume", "block").distinct().join(lists, "volume").select("volume", "block", none("offset"), none("first_s"), none("last_s"), "bases")

    def score(key, left, right):
        bases = right["bases"].drop_null()
        if not len(bases) or len(right) == 1 or not left.num_rows:
            return _told(key, [], [], [])
        right = right.filter(pc.is_valid(right["offset"]))
        idx, start, end = (left[c].to_numpy() for c in ("idx", "start_s", "end_s"))
        order = np.argsort(idx, kind="stable")
        idx, start, end = idx[order], start[order], end[order]
        offset, first = (right[c].to_numpy() for c in ("offset", "first_s"))
        known, last = pc.is_valid(right["last_s"]).to_numpy(), pc.fill_null(right["last_s"], 0).to_numpy()
        rows = []
        for base in bases[0].as_py():
            mine = np.flatnonzero((offset - base) % size == 0)
            place = (offset[mine] - base) // size
            low, high = np.searchsorted(idx, place, "left"), np.searchsorted(idx, place, "right")
            found = error = sure = 0
            while len(mine):  # the first slot of each mark's number, then the second
                held = low < high
                mine, low, high = mine[held], low[held], high[held]
                good = (first[mine] >= start[low] - late) & (first[mine] <= end[low] + late)
                m, s = mine[good], low[good]
                found, sure = found + len(m), sure + int(known[m].sum())
                error += int(((np.abs(first[m] - start[s]) + np.abs(last[m] - end[s])) * known[m]).sum())
                low = low + 1
            if found:
                rows.append((base, found, error if sure else None))
        return _told(key, *zip(*rows)) if rows else _told(key, [], [], [])

    def _told(key, bases, found, error):
        volume = pa.array([key[0].as_py()] * len(bases), key[0].type)
        return pa.table({"volume": volume, **{n: pa.array(list(v), pa.int64()) for n, v in (("base", bases), ("found", found), ("error", error))}})

    numbers = lambda df, names: df.select("volume", "block", *[F.col(c).cast("bigint").alias(c) for c in names])
    sides = numbers(dealt, ("idx", "start_s", "end_s")), numbers(met, ("offset", "first_s", "last_s")).withColumn("bases", F.lit(None).cast("array<bigint>")).unionByName(told).withColumnsRenamed({"volume": "_v", "block": "_b"})
    return sides[0].groupBy("volume", "block").cogroup(sides[1].groupBy("_v", "_b")).applyInArrow(score, f"volume {kind}, base bigint, found bigint, error bigint")


def _most_voted(votes: DataFrame, kept: int) -> DataFrame:
    """The bases of most votes of each volume, smaller bases first; chosen within hashed parts first, so that no volume is one task."""
    order = [F.desc("votes"), "base"]
    parts = votes.withColumn("_p", F.pmod(F.xxhash64("base"), F.lit(64)))
    near = parts.withColumn("_n", F.row_number().over(Window.partitionBy("volume", "_p").orderBy(*order))).where(F.col("_n") <= kept)
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("volume").orderBy(*order))).where(F.col("_n") <= kept).drop("_n", "_p")
