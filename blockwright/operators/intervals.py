"""Intervals on lanes: running ends, gaps, overlaps, merging, silences, range joins and as-of joins.

A lane may hold a third of all rows, so nothing here orders a whole lane in one task. What a row needs of all rows
before it is a running maximum; it is taken in two steps: stretches of the order column are reduced to their own
maxima, the few stretch rows are run through, and each stretch then carries on from what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a stretch in units of the order column: a day of microseconds.
STRETCH = 86_400 * 1_000_000


def running_max(df: DataFrame, lanes: list[str], order: str, ties: list[str], value: Column, out: str, inclusive: bool = False, stretch: int = STRETCH) -> DataFrame:
    """Adds ``out``: the greatest value among the rows of the lane before this one (and this one, if inclusive).

    The order is (order, ties). Null values are passed over; a null order comes first.
    """
    kept = df.columns
    at = df.withColumn("_v", value).withColumn("_s", F.floor(F.col(order) / stretch).cast("bigint"))
    sums = at.groupBy(*lanes, "_s").agg(F.max("_v").alias("_m"))
    before = Window.partitionBy(*lanes).orderBy(F.col("_s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_c", F.max("_m").over(before)).select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(lanes)], F.col("_s").alias("_ks"), "_c")
    same = F.col("_s").eqNullSafe(F.col("_ks"))
    for k, c in enumerate(lanes):
        same = F.col(c).eqNullSafe(F.col(f"_k{k}")) & same
    inside = Window.partitionBy(*lanes, "_s").orderBy(F.col(order).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    run = at.join(carried, same, "left").withColumn("_r", F.max("_v").over(inside))
    return run.withColumn(out, F.greatest("_c", "_r")).select(*kept, out)


def gaps(df: DataFrame, lane: str, start: str, end: str, tie: str, over: int) -> DataFrame:
    """(lane, gap_start, gap_end): stretches longer than ``over`` between the greatest end so far and the next start."""
    run = running_max(df, [lane], start, [tie], F.col(end), "_end")
    return run.where(F.col(start) - F.col("_end") > over).select(lane, F.col("_end").alias("gap_start"), F.col(start).alias("gap_end"))


def overlaps(df: DataFrame, lane: str, start: str, end: str, tie: str, slack: int) -> DataFrame:
    """Rows that start more than ``slack`` before the greatest end so far, with that end as ``running_end``."""
    return running_max(df, [lane], start, [tie], F.col(end), "running_end").where(F.col(start) < F.col("running_end") - slack)


def merged(df: DataFrame, lanes: list[str], start: str, end: str, tie: str, slack: int) -> DataFrame:
    """(lanes, start, end, members): intervals joined where the next starts no later than ``slack`` after the end so far."""
    run = running_max(df, lanes, start, [tie], F.col(end), "_end")
    opens = F.when(F.col("_end").isNull() | (F.col(start) > F.col("_end") + slack), F.col(start))
    run = running_max(run, lanes, start, [tie], opens, "_island", inclusive=True)
    return run.groupBy(*lanes, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_island")


def overlap_join(left: DataFrame, right: DataFrame, ls: str, le: str, rs: str, re: str, width: int, strict: bool = True) -> DataFrame:
    """Pairs whose intervals overlap, by buckets of ``width``; column names of both sides must differ.

    A pair that shares several buckets is given in the later of the two first buckets alone. Intervals of many
    buckets cost as many rows: choose a width near the common length.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    a = left.withColumn("_b", F.explode(F.sequence(bucket(ls), F.greatest(bucket(le), bucket(ls)))))
    b = right.withColumn("_c", F.explode(F.sequence(bucket(rs), F.greatest(bucket(re), bucket(rs)))))
    meets = (F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) if strict else (F.col(ls) <= F.col(re)) & (F.col(le) >= F.col(rs))
    return a.join(b, F.col("_b") == F.col("_c")).where(meets & (F.col("_b") == F.greatest(bucket(ls), bucket(rs)))).drop("_b", "_c")


def asof_join(left: DataFrame, right: DataFrame, lanes: list[str], left_on: str, right_on: str, take: list[str], within: int | None = None, forward: bool = False, stretch: int = STRETCH) -> DataFrame:
    """Left rows with ``take`` of the nearest right row at or before ``left_on`` (forward: at or after) in the lane.

    Only right rows no further than ``within`` count. Right rows with equal ``right_on``: the one with the greatest
    (forward: smallest) taken values. Union and running maximum; no lane is ordered in one task.
    """
    sign = -1 if forward else 1
    key = "_t"
    held = F.struct(*[F.col(c) for c in left.columns])
    taken = F.struct(F.col("_t").alias("t"), *[(F.col(c) * sign).alias(c) if forward and dict(right.dtypes)[c] in ("int", "bigint", "double") else F.col(c) for c in take])
    a = left.select(*lanes, (F.col(left_on) * sign).alias(key), F.lit(1).alias("_side"), held.alias("_left"), F.monotonically_increasing_id().alias("_row"))
    b = right.select(*lanes, (F.col(right_on) * sign).alias(key), *take).select(*lanes, key, F.lit(0).alias("_side"), taken.alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    run = running_max(both, lanes, key, ["_side"], F.col("_right"), "_got", inclusive=True, stretch=stretch).where("_side = 1")
    near = F.lit(True) if within is None else F.col(key) - F.col("_got.t") <= within
    back = lambda c: F.col(f"_got.{c}") * sign if forward and dict(right.dtypes)[c] in ("int", "bigint", "double") else F.col(f"_got.{c}")
    return run.select("_left.*", *[F.when(near, back(c)).alias(c) for c in take])


def islands(df: DataFrame, lanes: list[str], order: str, ties: list[str], breaks: Column, out: str, stretch: int = STRETCH) -> DataFrame:
    """Adds ``out``: the order value of the row that opened the current run; ``breaks`` says which rows open one."""
    return running_max(df, lanes, order, ties, F.when(breaks, F.col(order)), out, inclusive=True, stretch=stretch)
