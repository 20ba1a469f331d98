"""Geometry of unknown tokens: what stands behind the places of a byte string, as lengths and dates."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a field may begin after a token's start, its widths, and the years that dates may fall in (fixed values).
OFFSETS, WIDTHS, YEARS = range(4, 32, 2), (1, 2, 4), (2005, 2035)
GEOMETRY = "token string, offset int, width int, places long, pairs long, equal long, unix long, packed long"
#: Bytes of buffers that are looked at together.
TOGETHER = 1 << 20
#: Least share of a token's places at which a field counts as one, and how many date fields are told.
LEAST_SHARE, DATES_TOLD = 0.5, 3


def _is_packed(v: np.ndarray) -> np.ndarray:
    """Which numbers are sound packed dates."""
    year, month, day, hour, minute, second = (v >> 26 & 63) + 2000, v >> 22 & 15, v >> 17 & 31, v >> 12 & 31, v >> 6 & 63, v & 63
    return (year >= YEARS[0]) & (year <= YEARS[1]) & (month >= 1) & (month <= 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60)


def _is_unix(v: np.ndarray) -> np.ndarray:
    """Which numbers are seconds of those years."""
    low, high = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in YEARS)
    return (v >= low) & (v <= high)


def _parts(sizes: np.ndarray):
    """(first, past the last) of runs of buffers that are looked at together; a larger one is looked at alone."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + TOGETHER, side="right")))
        yield first, last
        first = last


def _places(data: np.ndarray, token: bytes) -> np.ndarray:
    """Every place where the token starts, overlapping ones included: those of its first byte, less those where a later one differs."""
    at = np.flatnonzero(data[: max(0, len(data) - len(token) + 1)] == token[0])
    for k, byte in enumerate(token[1:], 1):
        at = at[data[at + k] == byte]
    return at


def _geometry(data: np.ndarray, ends: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """(token, offset, width) by (places, pairs, equal, unix, packed) of buffers that lie end to end in ``data``: fields that fit into their buffer, gaps to the next place in it, and fields that equal the gap."""
    out = np.zeros((len(tokens), len(OFFSETS), len(WIDTHS), 5), np.int64)
    for t, token in enumerate(tokens):
        at = _places(data, token)
        owner = np.searchsorted(ends, at, side="right")
        inside = at + len(token) <= ends[owner]
        at, owner = at[inside], owner[inside]
        gap = np.where(owner[1:] == owner[:-1], at[1:] - at[:-1], -1)
        gap = np.append(gap, -1) if len(at) else at
        room = ends[owner] - at
        out[t, ..., :2] = len(at), (gap >= 0).sum()
        for i, offset in enumerate(OFFSETS):
            held = np.flatnonzero(room > offset)
            value, place = np.zeros(len(held), np.int64), at[held] + offset
            for k in range(max(WIDTHS)):
                fits = room[held] > offset + k
                held, place, value = held[fits], place[fits], value[fits]
                value |= data[place + k].astype(np.int64) << 8 * k
                if k + 1 in WIDTHS:
                    j = WIDTHS.index(k + 1)
                    out[t, i, j, 2] = (value == gap[held]).sum()
                    if k + 1 == 4 and offset % 4 == 0:
                        out[t, i, j, 3:] = _is_unix(value).sum(), _is_packed(value).sum()
    return out


def geometry_of(data: bytes, token: bytes) -> np.ndarray:
    """(offset, width) by (places, pairs, equal, unix, packed) of one buffer."""
    return _geometry(np.frombuffer(data, np.uint8), np.array([len(data)]), [token])[0]


def token_geometry(buffers: DataFrame, tokens: list[bytes], data: str = "data") -> DataFrame:
    """(token, offset, width, places, pairs, equal, unix, packed) over all buffers, overlapping places included.

    ``pairs`` are places with a next one in the same buffer, ``equal`` those whose little-endian field at ``offset`` is the
    distance to it, ``unix`` and ``packed`` the places whose field is a date of either kind (4 bytes on 4-byte places).
    Tasks hand out sums alone: a row for each token and field, whatever the number of places.
    """
    if not tokens or any(not t for t in tokens):
        raise ValueError("tokens must not be empty")

    def run(batches):
        total = np.zeros((len(tokens), len(OFFSETS), len(WIDTHS), 5), np.int64)
        for batch in batches:
            for first, last in _parts(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)):
                part = pc.fill_null(batch.column(0).slice(first, last - first), b"").cast(pa.large_binary())
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                total += _geometry(data, offsets[1:] - offsets[0], tokens)
        t, i, j = (x.reshape(-1) for x in np.indices(total.shape[:3]))
        names = [token.decode("latin-1") for token in tokens]
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in t]), pa.array(np.array(OFFSETS)[i], pa.int32()), pa.array(np.array(WIDTHS)[j], pa.int32()), *(pa.array(total[..., k].reshape(-1)) for k in range(5))], [c.split()[0] for c in GEOMETRY.split(", ")]
        )

    parts = buffers.select(F.col(data).cast("binary")).mapInArrow(run, GEOMETRY)
    return parts.groupBy("token", "offset", "width").agg(*[F.sum(c).alias(c) for c in ("places", "pairs", "equal", "unix", "packed")])


def token_fields(geometry: DataFrame) -> DataFrame:
    """(token, places, length_offset, length_width, length_share, dates): the field that most often is the distance to the next place (wider first, then nearer), and up to three date fields of half the places or more."""
    field = F.struct(F.col("equal").alias("n"), F.col("width").alias("width"), (-F.col("offset")).alias("back"))
    share = lambda c: F.try_divide(F.col(c), F.col("places"))
    dates = F.concat(*[F.when(share(c) >= LEAST_SHARE, F.array(F.struct((-share(c)).alias("s"), F.lit(c).alias("kind"), F.col("offset").alias("offset")))).otherwise(F.array().cast("array<struct<s:double,kind:string,offset:int>>")) for c in ("packed", "unix")])
    by = geometry.groupBy("token").agg(F.max("places").alias("places"), F.max("pairs").alias("pairs"), F.max(field).alias("f"), F.flatten(F.collect_list(dates)).alias("d"))
    told = F.transform(F.slice(F.array_sort("d"), 1, DATES_TOLD), lambda x: F.struct(x["kind"].alias("kind"), x["offset"].alias("offset"), (-x["s"]).alias("share")))
    found = (F.col("pairs") > 0) & (F.col("f.n") > 0)
    return by.select("token", "places", F.when(found, -F.col("f.back")).alias("length_offset"), F.when(found, F.col("f.width")).alias("length_width"), F.when(found, F.try_divide(F.col("f.n"), F.col("pairs"))).alias("length_share"), told.alias("dates"))
