"""Ordered rows: runs, wrap-aware splits, repeats, counters, decode state, moving medians."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import wrapped_difference
from .intervals import STRETCH, running_max


def with_previous(df: DataFrame, lanes: list[str], order: str, ties: list[str], columns: list[str], stretch: int = STRETCH) -> DataFrame:
    """Adds prev_<column>: values of the row before in the lane. A running maximum over (order, ties, values), so a long lane is no single task."""
    value = F.struct(F.col(order), *[F.col(t) for t in ties], *[F.col(c).alias(f"p_{c}") for c in columns])
    run = running_max(df, lanes, order, ties, value, "_p", stretch=stretch)
    return run.select(*df.columns, *[F.col(f"_p.p_{c}").alias(f"prev_{c}") for c in columns])


def runs(df: DataFrame, lanes: list[str], order: str, ties: list[str], breaks: Column, out: str = "run", stretch: int = STRETCH) -> DataFrame:
    """Adds ``out``: the order value that opened the row's run. ``breaks`` may use prev_ columns; a lane's first row opens one anyway."""
    return running_max(df, lanes, order, ties, F.when(F.coalesce(breaks, F.lit(True)), F.col(order)), out, inclusive=True, stretch=stretch)


def stitched(
    df: DataFrame, lanes: list[str], order: str, stretch: int, before: dict[str, Column], sure: Column, maybe: Column, ends: dict[str, Column], opens: Column, out: str, measures: dict[str, tuple[Column, Callable]]
) -> DataFrame:
    """(lanes, out, measures) of each run of a lane's rows; ``out`` is the order value of the row that opened it. Rows are dealt to stretches once.

    Within a stretch, ``before`` adds the greatest of each value among the rows before. ``sure`` says which rows open a
    run whatever came before the stretch; ``maybe`` marks the one row before all of these that opens one if ``opens``
    holds: a condition on _row (the greatest of each of ``ends`` up to that row in its stretch) and on _past (the
    greatest before the stretch). Runs that begin and end in a stretch are told there; of each stretch one row goes on,
    with what stands before its first sure row and after its last. A lane's first row opens a run anyway. Measures are
    (aggregate of rows, aggregate of those). Rows of null order are one run, of null, and open and close nothing.
    """
    up, down = Window.unboundedPreceding, Window.unboundedFollowing
    inside = Window.partitionBy(*lanes, "_s").orderBy(F.col(order).asc_nulls_first())
    at = df.withColumn("_s", F.floor(F.col(order) / stretch).cast("bigint")).select("*", *[F.max(v).over(inside.rowsBetween(up, -1)).alias(n) for n, v in before.items()])
    end = F.struct(*[v.alias(n) for n, v in ends.items()])
    at = at.withColumn("_sure", F.when(sure, F.col(order))).withColumn("_may", F.when(maybe, F.col(order)))
    at = at.select(
        "*", F.max("_sure").over(inside.rowsBetween(up, 0)).alias("_g"), F.max("_may").over(inside.rowsBetween(up, 0)).alias("_c"), F.max("_sure").over(inside.rowsBetween(up, down)).alias("_top"),
        F.max(F.when(F.col("_may").isNotNull(), end)).over(inside.rowsBetween(up, down)).alias("_row"), *[F.max(v).over(inside.rowsBetween(up, down)).alias(f"_e_{n}") for n, v in ends.items()],
    )
    told = [f"_e_{n}" for n in ends]
    pieces = at.groupBy(*lanes, "_s", "_g", "_c", "_top", "_row", *told).agg(F.min(order).alias("_first"), *[a.alias(n) for n, (a, _) in measures.items()])
    inner = F.col("_s").isNull() | (F.col("_g") < F.col("_top"))
    done = pieces.where(inner).select(*lanes, F.col("_g").alias(out), *measures)
    edge = pieces.where(~F.coalesce(inner, F.lit(False))).groupBy(*lanes, "_s", "_top", "_row", *told)
    one = edge.agg(F.max("_c").alias("_c"), F.min("_first").alias("_first"), F.collect_list(F.struct("_g", "_c", *measures)).alias("_pieces"))  # three at most
    lane = Window.partitionBy(*lanes).orderBy("_s")
    past = F.struct(*[F.max(f"_e_{n}").over(lane.rowsBetween(up, -1)).alias(n) for n in ends])
    one = one.select("*", past.alias("_past"), F.min("_first").over(lane.rowsBetween(up, 0)).alias("_lead"))
    one = one.withColumn("_o", F.when(opens, F.col("_c")))
    one = one.withColumn("_on", F.max(F.coalesce("_top", "_o")).over(lane.rowsBetween(up, -1)))
    parts = one.select(*lanes, "_o", "_on", "_lead", F.explode("_pieces").alias("_x"))
    opened = F.coalesce("_x._g", F.when(F.col("_x._c").isNotNull(), F.col("_o")), "_on", "_lead")
    rest = parts.select(*lanes, opened.alias(out), *[F.col(f"_x.{n}").alias(n) for n in measures]).groupBy(*lanes, out).agg(*[merge(n).alias(n) for n, (_, merge) in measures.items()])
    return done.unionByName(rest)


def clock_runs(packs: DataFrame, lane: str, order: str, offset: str, length: str, clock: str, jump: int, bits: int = 33, stretch: int = STRETCH) -> DataFrame:
    """Packs split into streams: where the bytes do not follow on, or a wrapping clock jumps by more than ``jump`` either way."""
    prev = with_previous(packs, [lane], order, [], [offset, length, clock], stretch)
    breaks = (F.col(f"prev_{offset}") + F.col(f"prev_{length}") != F.col(offset)) | (F.abs(wrapped_difference(F.col(clock), F.col(f"prev_{clock}"), bits)) > jump)
    return runs(prev, [lane], order, [], breaks, "stream", stretch).drop(*[f"prev_{c}" for c in (offset, length, clock)])


def not_repeated(df: DataFrame, lanes: list[str], order: str, ties: list[str], counter: str, stretch: int = STRETCH) -> DataFrame:
    """Rows whose counter exceeds every counter before it in the lane: what is kept when repeats of the last kept row are dropped."""
    run = running_max(df, lanes, order, ties, F.col(counter), "_top", stretch=stretch)
    return run.where(F.col("_top").isNull() | (F.col(counter) > F.col("_top"))).drop("_top")


def missing_counters(df: DataFrame, lanes: list[str], counter: str) -> DataFrame:
    """Per lane: rows, span of the counter, and how many of its values are missing."""
    span = F.max(counter) - F.min(counter) + 1
    return df.groupBy(*lanes).agg(F.count("*").alias("n"), span.alias("span"), (span - F.countDistinct(counter)).alias("missing"))


def decode_classes(df: DataFrame, lanes: list[str], order: str, key: Column, counter: str, stretch: int = STRETCH) -> DataFrame:
    """Adds state: before_key, after_gap (a counter gap since the last key) or clean."""
    prev = with_previous(df, lanes, order, [], [counter], stretch)
    gap = F.col(counter) - F.col(f"prev_{counter}") > 1
    run = running_max(prev, lanes, order, [], F.when(key, F.col(order)), "_key", inclusive=True, stretch=stretch)
    run = running_max(run, lanes, order, [], F.when(gap & ~key, F.col(order)), "_gap", inclusive=True, stretch=stretch)
    state = F.when(F.col("_key").isNull(), "before_key").when(F.col("_gap") > F.col("_key"), "after_gap").otherwise("clean")
    return run.withColumn("state", state).drop("_key", "_gap", f"prev_{counter}")


def local_index(cells: DataFrame, lane: str, order: str, value: str, side: int, block: int = 4096) -> DataFrame:
    """Adds local_median: the upper median of the rows within ``side`` rows on either side.

    Rows are numbered over the lane in two steps (rows per stretch, then inside it), cut into blocks of rows, and a
    block borrows ``side`` rows of its neighbours, so that no lane is ordered in one task.
    """
    numbered = row_numbers(cells, [lane], order, [])
    home = F.floor(F.col("_n") / block)
    near = F.array_distinct(F.array(F.floor((F.col("_n") - side) / block), home, F.floor((F.col("_n") + side) / block)))
    spread = numbered.withColumn("_home", home).withColumn("_b", F.explode(near))
    w = Window.partitionBy(lane, "_b").orderBy("_n").rangeBetween(-side, side)
    ordered = F.sort_array(F.collect_list(value).over(w))
    out = spread.withColumn("_l", ordered).where("_b = _home")
    return out.withColumn("local_median", F.element_at("_l", (F.size("_l") / 2).cast("int") + 1)).drop("_l", "_b", "_home", "_n")


def row_numbers(df: DataFrame, lanes: list[str], order: str, ties: list[str], stretch: int = STRETCH) -> DataFrame:
    """Adds _n: the row's number from 0 in its lane."""
    at = df.withColumn("_s", F.floor(F.col(order) / stretch).cast("bigint"))
    counts = at.groupBy(*lanes, "_s").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*lanes).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy(*lanes, "_s").orderBy(order, *ties)
    return at.join(base, [*lanes, "_s"]).withColumn("_n", F.row_number().over(inside) - 1 + F.col("_base")).select(*df.columns, "_n")


def lane_median(cells: DataFrame, lane: str, value: str) -> DataFrame:
    """Upper median of a lane's values, by counting distinct values: values are counted first, and only counts are ordered."""
    counts = cells.groupBy(lane, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(lane).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(lane)
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(total))
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(lane).agg(F.min(value).alias("median"), F.max("n").alias("n"))
