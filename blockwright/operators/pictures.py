"""Access units: NAL units grouped into pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import running_max
from .sequence import stitched

#: NAL types of slices, and types that open a picture after one (fixed values).
SLICES, OPENERS = (1, 5), (6, 7, 8, 9, *range(14, 19))


def _roles(type_col: str, first_slice: str) -> tuple[Column, Column]:
    """Whether a unit is a slice, and whether it may open a picture."""
    slice_ = F.coalesce(F.col(type_col).between(*SLICES), F.lit(False))
    return slice_, F.coalesce(F.col(type_col).isin(*OPENERS), F.lit(False)) | (slice_ & F.coalesce(F.col(first_slice), F.lit(False)))


def access_units(units: DataFrame, lanes: list[str], order: str, type_col: str, first_slice: str, stretch: int) -> DataFrame:
    """Rows with ``picture``, the order value of the row that opens their access unit.

    A picture ends where, after a slice of its own, a delimiter, parameter set or the like follows, or a slice that is a
    picture's first (``first_slice``). Such a row opens one if no other has come since the last slice: two running maxima
    tell, so a lane is no single task. Null types and flags are of no kind. Order values of a lane must differ.
    """
    slice_, may_open = _roles(type_col, first_slice)
    kept = units.columns
    run = running_max(units, lanes, order, [], F.when(slice_, F.col(order)), "_slice", stretch=stretch)
    run = running_max(run, lanes, order, [], F.when(may_open, F.col(order)), "_open", stretch=stretch)
    opens = may_open & F.col("_slice").isNotNull() & (F.col("_open").isNull() | (F.col("_open") <= F.col("_slice")))
    run = running_max(run.withColumn("_starts", F.when(opens, F.col(order))), lanes, order, [], F.col("_starts"), "_unit", inclusive=True, stretch=stretch)
    run = running_max(run, lanes, order, [], -F.col(order), "_lead", inclusive=True, stretch=stretch)  # the lane's first row opens its first
    return run.select(*kept, F.coalesce("_unit", -F.col("_lead")).alias("picture"))


def picture_table(units: DataFrame, lanes: list[str], order: str, type_col: str, first_slice: str, stretch: int) -> DataFrame:
    """(lanes, picture, nals, slices, key, last) of each access unit of ``access_units``; key: it has an IDR slice.

    A slice in the stretch tells whether the next row that may open a picture does; of the rows before any slice the
    first that may open one waits for what the stretches before end with.
    """
    slice_, may_open = _roles(type_col, first_slice)
    seen, opened = F.col("_slice"), F.col("_open")
    ready = lambda s, o: s.isNotNull() & (o.isNull() | (o <= s))
    ends = {"slice": F.when(slice_, F.col(order)), "open": F.when(may_open, F.col(order))}
    measures = {
        "nals": (F.count("*"), F.sum), "slices": (F.count_if(F.col(type_col).between(*SLICES)), F.sum),
        "key": (F.coalesce(F.bool_or(F.col(type_col) == 5), F.lit(False)), F.bool_or), "last": (F.max(order), F.max),
    }
    return stitched(
        units, lanes, order, stretch, {"_slice": ends["slice"], "_open": ends["open"]}, may_open & ready(seen, opened), may_open & seen.isNull() & opened.isNull(), ends,
        ready(F.col("_past.slice"), F.col("_past.open")), "picture", measures,
    )
