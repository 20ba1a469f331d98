"""Carving: footage found by its structure alone, with no index.

Headers are found block by block in parallel, each block seeing enough of the next to judge what starts in it. What
needs order (which stream a frame belongs to) runs once per volume over the small rows of headers.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import OrderedDict
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros, packed_date, wrapped_difference
from . import intervals, match, sequence, store

#: DHAV frames: magic, trailer, frame types, largest frame (fixed values).
FRAME, TRAILER, HEADER, TAIL, LARGEST = b"DHAV", b"dhav", 24, 8, 4 << 20
VIDEO, KEY, KNOWN = frozenset((0xFD, 0xFC, 0xFB)), 0xFD, frozenset((0xFD, 0xFC, 0xFB, 0xF0, 0xF1))
#: Continuity of one stream: counter steps, milliseconds, seconds (fixed values).
STEP_BACK, STEP_ON, MS_ON, MS_BACK, DATE_BACK, DATE_ON = 4, 128, 4000, 500, 1, 4
#: A stream silent for so many bytes is closed; shorter streams are counted only; how clearly the best stream must win (fixed values).
RETIRE, LEAST, CLEAR = 256 << 20, 25, 4.0
#: Program streams: pack header, clock rate and jump, bytes looked ahead (fixed values).
PACK, CLOCK_HZ, CLOCK_JUMP, PACK_AHEAD = b"\x00\x00\x01\xba", 90_000, 450_000, 1 << 20

FRAME_SCHEMA = "volume long, offset long, ftype int, frame_number long, length long, date long, ms int, ext_length int"


def sound_frame(data: bytes, at: int) -> tuple | None:
    """(type, counter, length, date, ms, extension) of the frame whose header stands here; None if something of it is not sound."""
    if at + HEADER > len(data):
        return None
    _, kind, _, _, _, number, length, date, ms, ext, check = struct.unpack_from("<4sBBBBIIIHBB", data, at)
    if sum(data[at : at + 23]) & 0xFF != check or kind not in KNOWN or not HEADER + TAIL + ext <= length <= LARGEST:
        return None
    return (kind, number, length, date, ms, ext) if data[at + length - 8 : at + length] == TRAILER + data[at + 12 : at + 16] else None


def frames_in(data: bytes, base: int, stop: int, nested: bool = False) -> list[tuple]:
    """(offset, type, counter, length, date, ms, extension) of valid frames whose header starts before ``stop``.

    Valid: checksum of the header, known type, sound lengths, and a trailer that repeats the length. A valid frame's
    bytes are not searched for others, unless ``nested`` asks for them.
    """
    found, clear = [], 0
    for m in re.finditer(FRAME, data):
        at = m.start()
        if at >= stop:
            break
        if at >= clear and (frame := sound_frame(data, at)):
            found.append((base + at, *frame))
            clear = clear if nested else at + frame[2]
    return found


def frames(blocks: DataFrame, volume: int = 0) -> DataFrame:
    """Valid frames of blocks read with at least LARGEST bytes of look-ahead; what lies inside a frame is no frame, whichever block it is in."""
    names = ("offset", "ftype", "frame_number", "length", "date", "ms", "ext_length")

    def run(batches):
        for batch in batches:
            for offset, content, after in zip(*(c.to_pylist() for c in batch.columns)):
                rows = frames_in(content + (after or b""), offset, len(content), nested=True)
                cols = list(zip(*rows)) if rows else [()] * len(names)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([volume] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names=["volume", *names])

    return unnested(blocks.select("offset", "content", "after").mapInArrow(run, FRAME_SCHEMA))


#: Bytes of an image whose rows are ordered together.
CELL = 8 << 20


def _row_by_row(rows: DataFrame) -> DataFrame:
    """Rows of small clusters, each gone through once in order; what is held is where the last kept row ends."""
    names = rows.columns
    at = [names.index(c) for c in ("volume", "_cluster", "offset", "length")]

    def run(batches):
        now, clear = None, 0
        for batch in batches:
            keep = []
            for volume, cluster, offset, length in zip(*(batch.column(k).to_pylist() for k in at)):
                if (volume, cluster) != now:
                    now, clear = (volume, cluster), offset
                keep.append(offset >= clear)
                if keep[-1]:
                    clear = offset + length
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("volume", "_cluster").sortWithinPartitions("volume", "_cluster", "offset", "length").mapInArrow(run, rows.schema)


def unnested(found: DataFrame, cell: int = CELL) -> DataFrame:
    """What a search from the front finds: a row that starts inside a kept row is dropped, and so hides nothing itself.

    Cells of the image where no row starts before the greatest end so far are kept as they are, told by one order of
    each cell's own rows and a table of one row a cell. Only the other cells, and those that reach into the next, are
    cut into clusters (an end that no row before passes starts a new one) and gone through row by row.
    """
    found = store.once(found)
    end = F.col("offset") + F.col("length")
    inside = Window.partitionBy("volume", "_cell").orderBy("offset", "length").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("_cell", F.floor(F.col("offset") / cell).cast("bigint"))
    cells = placed.withColumn("_before", F.max(end).over(inside)).groupBy("volume", "_cell").agg(F.min("offset").alias("first"), F.max(end).alias("top"), F.coalesce(F.bool_or(F.col("_before") > F.col("offset")), F.lit(False)).alias("mixed"))
    cells = sequence.running_max(cells, ["volume"], "_cell", [], F.col("top"), "before", stretch=4096)
    cells = sequence.running_max(cells.withColumn("_back", -F.col("_cell")), ["volume"], "_back", [], -F.col("first"), "after", stretch=4096)
    doubtful = store.once(cells.where(F.col("mixed") | (F.col("before") > F.col("first")) | (F.col("top") > -F.col("after"))).select("volume", "_cell"))
    if doubtful.isEmpty():
        return found
    some = placed.join(doubtful, ["volume", "_cell"], "left_semi").drop("_cell")
    run = sequence.running_max(some, ["volume"], "offset", ["length"], end, "_end", stretch=cell)
    opens = F.when(F.col("_end").isNull() | (F.col("offset") >= F.col("_end")), F.col("offset"))
    run = sequence.running_max(run, ["volume"], "offset", ["length"], opens, "_cluster", inclusive=True, stretch=cell)
    return placed.join(doubtful, ["volume", "_cell"], "left_anti").select(*found.columns).unionByName(_row_by_row(run.drop("_end")).select(*found.columns))


#: Columns of a finished piece of footage; ``sid`` counts the streams of a stretch of the volume.
PIECE = "volume long, stretch long, sid long, offset long, length long, frames long, video_frames long, i_frames long, repeats long"
KINDS = ("video", "audio", "aux")


def frame_runs(found: DataFrame, cell: int = CELL) -> DataFrame:
    """Frames collapsed to runs: each frame touches the one before, its clock and date go on, and so does its kind's counter.

    Rows (volume, offset, end, frames, sums, first and last counter of each kind, first and last clocks, the frames
    themselves as an array). A run says all that a stream has to know of it, unless the stream cannot take it whole.
    All steps order rows of one cell, after one shuffle.
    """
    kind = F.when(F.col("ftype").isin(*VIDEO), 0).when(F.col("ftype") == 0xF0, 1).otherwise(2)
    dated = found.select(
        "volume", "offset", "length", "frame_number", "ms", kind.alias("kind"), (F.col("ftype") == KEY).alias("key"), F.floor(micros(packed_date(F.col("date"))) / 1_000_000).cast("bigint").alias("seconds"),
        F.floor(F.col("offset") / cell).cast("bigint").alias("_cell"),
    )
    by = Window.partitionBy("volume", "_cell").orderBy("offset")
    prev = lambda c: F.lag(c).over(by)
    on = F.pmod(F.col("ms") - prev("ms") + 0x8000, F.lit(0x10000)) - 0x8000
    follows = (prev("offset") + prev("length") == F.col("offset")) & on.between(-MS_BACK, MS_ON) & (F.col("seconds") - prev("seconds")).between(-DATE_BACK, DATE_ON)
    chains = dated.withColumn("_f", F.when(~F.coalesce(follows, F.lit(False)), F.col("offset"))).withColumn("_chain", F.max("_f").over(by))
    own = Window.partitionBy("volume", "_cell", "_chain", "kind").orderBy("offset")
    stepped = chains.withColumn("_step", F.col("frame_number") - F.lag("frame_number").over(own))
    odd = F.when((F.col("_f").isNotNull()) | ~F.coalesce(F.col("_step").between(1, STEP_ON), F.lit(True)), F.col("offset"))
    runs = stepped.withColumn("_o", odd).withColumn("_run", F.max("_o").over(by))
    frame = F.struct("offset", "length", "kind", "key", "frame_number", "ms", "seconds")
    each = [f(F.when(F.col("kind") == k, F.col("frame_number"))).alias(f"{n}_{name}") for k, name in enumerate(KINDS) for n, f in (("first", F.min), ("last", F.max))]
    by_run = runs.groupBy("volume", "_cell", "_run").agg(
        F.max("offset").alias("last_offset"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("frames"), F.count_if(F.col("kind") == 0).alias("video_frames"), F.count_if("key").alias("i_frames"), *each,
        F.array_sort(F.collect_list(frame)).alias("rows"),
    )
    return by_run.withColumnRenamed("_run", "offset").drop("_cell")


class Streams:
    """Open streams of a stretch of a volume, least recently added to first, and those whose last frame is of a given second.

    A run that touches the last placed frame goes where that one went, if its clocks allow it; the search for another
    stream looks at those alone whose second is near enough. A run whose counters go on in each kind is taken whole;
    any other is taken frame by frame, and a frame whose counter its stream has passed is a repeat.
    """

    def __init__(self):
        self.open: OrderedDict[int, dict] = OrderedDict()
        self.at_second: dict[int | None, set[int]] = {}
        self.placed = (None, None)  # where the last placed frame ends, and its stream
        self.count = 0
        self.done: list[tuple] = []

    def distance(self, sid: int, frame: dict) -> float | None:
        """How far the frame is from following the stream; None if it cannot."""
        tip = self.open[sid]
        on = (frame["ms"] - tip["ms"] + 0x8000) % 0x10000 - 0x8000
        if tip["seconds"] is None or frame["seconds"] is None or not -DATE_BACK <= frame["seconds"] - tip["seconds"] <= DATE_ON or not -MS_BACK <= on <= MS_ON:
            return None
        newest = tip["newest"][frame["kind"]]
        step = 1 if newest is None else frame["frame_number"] - newest
        return abs(on) / 40 + abs(step - 1) if -STEP_BACK <= step <= STEP_ON else None

    def _leave(self, sid: int) -> dict:
        stream = self.open.pop(sid)
        self.at_second[stream["seconds"]].discard(sid)
        return stream

    def _tell(self, sid: int, stream: dict) -> None:
        if stream["piece"] or stream["repeats"]:
            self.done.append((sid, *(stream["piece"] or (None, 0, 0, 0, 0)), stream["repeats"]))
        stream["piece"], stream["repeats"] = None, 0

    def find(self, frame: dict) -> int:
        """The stream for a frame; a new one where none follows, or none clearly best."""
        while self.open and frame["offset"] - next(iter(self.open.values()))["offset"] > RETIRE:
            sid = next(iter(self.open))
            self._tell(sid, self._leave(sid))
        end, sid = self.placed
        if end == frame["offset"] and sid in self.open and self.distance(sid, frame) is not None:
            return sid
        near = []
        if frame["seconds"] is not None:
            for second in range(frame["seconds"] - DATE_ON, frame["seconds"] + DATE_BACK + 1):
                near += [(d, x) for x in self.at_second.get(second, ()) if (d := self.distance(x, frame)) is not None]
        near.sort()
        if near and (len(near) == 1 or near[1][0] > CLEAR * max(near[0][0], 1.0)):
            return near[0][1]
        self.count += 1
        self.open[self.count - 1] = {"offset": frame["offset"], "ms": None, "seconds": None, "newest": [None] * len(KINDS), "piece": None, "repeats": 0}
        self.at_second.setdefault(None, set()).add(self.count - 1)
        return self.count - 1

    def _put(self, sid: int, first: int, last: dict, newest: dict[int, int], sums: tuple[int, int, int, int]) -> None:
        """Footage from ``first`` on, up to the frame ``last``, goes on the stream."""
        stream = self._leave(sid)
        if stream["piece"] and stream["piece"][0] + stream["piece"][1] != first:
            self._tell(sid, stream)
        stream["piece"] = [first, *sums] if not stream["piece"] else [stream["piece"][0], *(a + b for a, b in zip(stream["piece"][1:], sums))]
        stream.update(offset=last["offset"], ms=last["ms"], seconds=last["seconds"])
        for kind, number in newest.items():
            stream["newest"][kind] = number
        self.open[sid] = stream  # now the most recent
        self.at_second.setdefault(stream["seconds"], set()).add(sid)
        self.placed = (last["offset"] + last["length"], sid)

    def add(self, frame: dict) -> None:
        sid = self.find(frame)
        newest = self.open[sid]["newest"][frame["kind"]]
        if newest is not None and frame["frame_number"] <= newest:
            self.open[sid]["repeats"] += 1
        else:
            self._put(sid, frame["offset"], frame, {frame["kind"]: frame["frame_number"]}, (frame["length"], 1, frame["kind"] == 0, frame["key"]))

    def add_run(self, run: dict, rows) -> None:
        """``rows`` gives the run's frames; of a run that is taken whole, the first and last alone are looked at."""
        first = rows[0].as_py()
        if run["frames"] > 1:
            sid = self.find(first)
            newest = self.open[sid]["newest"]
            if all(run[f"first_{name}"] is None or newest[k] is None or 1 <= run[f"first_{name}"] - newest[k] <= STEP_ON for k, name in enumerate(KINDS)):
                last = {k: run[f"last_{name}"] for k, name in enumerate(KINDS) if run[f"last_{name}"] is not None}
                self._put(sid, first["offset"], rows[-1].as_py(), last, (run["end"] - first["offset"], run["frames"], run["video_frames"], run["i_frames"]))
                return
        for frame in rows:
            self.add(frame.as_py())

    def close(self) -> list[tuple]:
        for sid in list(self.open):
            self._tell(sid, self._leave(sid))
        return self.told()

    def told(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def carved_pieces(found: DataFrame) -> DataFrame:
    """Pieces of footage (volume, sid, offset, length, frames, ...) of each volume's streams.

    Order decides, so runs pass through in disk order, batch by batch; what is held is the open streams. A silence that
    closes all streams cuts the volume into stretches, which are tasks of their own; streams are numbered through.
    """
    runs = store.once(frame_runs(found))
    prev = sequence.with_previous(runs.select("volume", "offset", "last_offset"), ["volume"], "offset", [], ["last_offset"], stretch=RETIRE)
    cuts = sequence.runs(prev, ["volume"], "offset", [], F.col("offset") - F.col("prev_last_offset") > RETIRE, "stretch", stretch=RETIRE).select("volume", "offset", "stretch")
    names = ["volume", "stretch", "frames", "video_frames", "i_frames", "end", *[f"{n}_{k}" for k in KINDS for n in ("first", "last")]]
    dealt = runs.join(cuts, ["volume", "offset"]).select(*names, "rows", "offset").repartition("volume", "stretch").sortWithinPartitions("volume", "stretch", "offset").drop("offset")
    out = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches):
        now, streams = None, Streams()

        def table(done):
            cols = list(zip(*done)) if done else [()] * 7
            return pa.RecordBatch.from_arrays([*(pa.array([x] * len(done), pa.int64()) for x in now or (None, None)), *(pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in cols)], names=out)

        for batch in batches:
            rows = batch.column(len(names))
            for k, values in enumerate(zip(*(batch.column(j).to_pylist() for j in range(len(names))))):
                if values[:2] != now:
                    if now is not None:
                        yield table(streams.close())
                    now, streams = values[:2], Streams()
                streams.add_run(dict(zip(names, values)), rows[k])
            yield table(streams.told())
        yield table(streams.close())

    pieces = store.once(dealt.mapInArrow(run, PIECE))
    counts = pieces.groupBy("volume", "stretch").agg((F.max("sid") + 1).alias("_c"))
    w = Window.partitionBy("volume").orderBy("stretch")
    base = counts.select("volume", "stretch", (F.sum("_c").over(w) - F.col("_c")).alias("_base"))
    return pieces.join(base, ["volume", "stretch"]).withColumn("sid", F.col("sid") + F.col("_base")).drop("stretch", "_base")


def frames_of_streams(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """Frames with the stream (sid) whose piece holds them; repeats are in none. The nearest piece before a frame is the one."""
    spans = pieces.where("length > 0").select("volume", F.col("offset").alias("piece"), (F.col("offset") + F.col("length")).alias("piece_end"), "sid")
    got = intervals.asof_join(found, spans, ["volume"], "offset", "piece", ["piece_end", "sid"], stretch=1 << 26)
    return got.withColumn("sid", F.when(F.col("offset") < F.col("piece_end"), F.col("sid"))).drop("piece_end")


def labelled_streams(streams: DataFrame, found: DataFrame, pieces: DataFrame, label: str, share: float = 0.9) -> DataFrame:
    """Streams with the label that ``share`` of their frames have (column ``label`` of the frames), else none; every stream stays."""
    each = frames_of_streams(found, pieces).where("sid is not null").withColumn("_stream", F.concat_ws(":", "volume", "sid"))
    told = match.majority_label(each.withColumn("_one", F.lit(1)), "_stream", label, "_one", share)
    named = streams.withColumn("_stream", F.concat_ws(":", "volume", "sid"))
    return named.join(told, "_stream", "left").drop("_stream")


def carve_streams(found: DataFrame, least: int = LEAST) -> DataFrame:
    """Streams of each volume from their pieces; ``kept`` marks those of ``least`` frames or more."""
    piece = F.when(F.col("length") > 0, F.struct("offset", "length"))
    by = carved_pieces(found).groupBy("volume", "sid").agg(
        F.min(F.when(F.col("length") > 0, F.col("offset"))).alias("first_offset"), *[F.sum(c).alias(c) for c in ("frames", "video_frames", "i_frames", "repeats")], F.sum("length").alias("bytes"),
        F.array_sort(F.collect_list(piece)).alias("extents"),
    )
    return by.withColumn("kept", F.col("frames") >= least)


def clock_of(head: bytes) -> int | None:
    """The 33-bit clock of an MPEG-2 pack header; None if it is no such header."""
    if len(head) < 14 or head[4] & 0xC0 != 0x40:
        return None
    bits = int.from_bytes(head[4:9], "big")  # two marks, 3 bits of the clock, a mark, 15 bits, a mark, 15 bits, a mark
    return (bits >> 35 & 7) << 30 | (bits >> 19 & 0x7FFF) << 15 | bits >> 3 & 0x7FFF


PACK_SCHEMA = "volume long, offset long, length long, scr long, video long, audio long"


def packs_in(data: bytes, base: int, stop: int, at_end: bool = False) -> list[np.ndarray]:
    """(offset, length, clock, video, audio) columns of the packs that start before ``stop``, nested ones too.

    A pack's packets end exactly at the next pack, or with ``at_end`` at the end of the data. All packs take their
    steps from packet to packet together.
    """
    d, n = np.frombuffer(data, np.uint8).astype(np.int64), len(data)
    at = np.array([m.start() for m in re.finditer(PACK, data)], np.int64)
    at = at[(at < stop) & (at + 14 <= n)]
    at = at[d[at + 4] & 0xC0 == 0x40]
    head = [d[at + k] for k in range(4, 9)]
    clock = (head[0] >> 3 & 7) << 30 | (head[0] & 3) << 28 | head[1] << 20 | (head[2] >> 3 & 31) << 15 | (head[2] & 3) << 13 | head[3] << 5 | head[4] >> 3
    place, length = at + 14 + (d[np.minimum(at + 13, n - 1)] & 7), np.zeros(len(at), np.int64)
    video, audio, live = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
    while len(live):
        here = place[live]
        inside = here + 4 <= n
        if at_end:
            last = live[here == n]
            length[last] = n - at[last]
        live, here = live[inside], here[inside]
        code = (d[here] == 0) & (d[here + 1] == 0) & (d[here + 2] == 1)
        live, here = live[code], here[code]
        kind = d[here + 3]
        done = kind == 0xBA
        length[live[done]] = here[done] - at[live[done]]
        end = kind == 0xB9
        go = end | ((kind >= 0xBB) & (here + 6 <= n))
        live, here, kind, end = live[go], here[go], kind[go], end[go]
        video[live] += (kind >= 0xE0) & (kind <= 0xEF)
        audio[live] += (kind >= 0xC0) & (kind < 0xE0)
        place[live] = here + np.where(end, 4, 6 + (d[np.minimum(here + 4, n - 1)] << 8 | d[np.minimum(here + 5, n - 1)]))
    ok = length > 0
    return [x[ok] for x in (at + base, length, clock, video, audio)]


def packs(blocks: DataFrame, volume: int = 0) -> DataFrame:
    """Valid packs (volume, offset, length, scr, video, audio) of blocks read with PACK_AHEAD bytes of look-ahead."""

    def run(batches):
        for batch in batches:
            for offset, content, after in zip(*(c.to_pylist() for c in batch.columns)):
                cols = packs_in(content + (after or b""), offset, len(content), len(after or b"") < PACK_AHEAD)
                yield pa.RecordBatch.from_arrays([pa.array([volume] * len(cols[0]), pa.int64()), *map(pa.array, cols)], names=["volume", "offset", "length", "scr", "video", "audio"])

    return unnested(blocks.select("offset", "content", "after").mapInArrow(run, PACK_SCHEMA))


def pack_runs(found: DataFrame, cell: int = CELL) -> DataFrame:
    """Packs of one cell collapsed to runs that touch and whose clocks go on; one shuffle, and rows of a cell are ordered."""
    by = Window.partitionBy("volume", "_cell").orderBy("offset")
    prev = lambda c: F.lag(c).over(by)
    goes_on = (prev("offset") + prev("length") == F.col("offset")) & (F.abs(wrapped_difference(F.col("scr"), prev("scr"), 33)) <= CLOCK_JUMP)
    at = found.withColumn("_cell", F.floor(F.col("offset") / cell).cast("bigint")).withColumn("_f", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("offset"))).withColumn("_run", F.max("_f").over(by))
    return at.groupBy("volume", "_cell", "_run").agg(
        F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("packs"), *[F.sum(c).alias(c) for c in ("length", "video", "audio")], F.min_by("scr", "offset").alias("first_scr"), F.max_by("scr", "offset").alias("last_scr"),
    ).withColumnRenamed("_run", "offset").drop("_cell")


def pack_streams(found: DataFrame, least: int = LEAST) -> DataFrame:
    """Runs of packs that touch and whose clocks go on; ``kept`` marks those of ``least`` packs or more. Runs of a cell come first, and meet over a table of few rows."""
    prev = sequence.with_previous(pack_runs(found), ["volume"], "offset", [], ["end", "last_scr"], stretch=1 << 34)
    breaks = (F.col("prev_end") != F.col("offset")) | (F.abs(wrapped_difference(F.col("first_scr"), F.col("prev_last_scr"), 33)) > CLOCK_JUMP)
    split = sequence.runs(prev, ["volume"], "offset", [], breaks, "stream", stretch=1 << 34)
    by = split.groupBy("volume", "stream").agg(F.sum("packs").alias("packs"), F.sum("length").alias("bytes"), F.sum("video").alias("video"), F.sum("audio").alias("audio"), F.min_by("first_scr", "offset").alias("first_scr"), F.max_by("last_scr", "offset").alias("last_scr"))
    return by.withColumn("kept", F.col("packs") >= least)


#: Index leaves: 48 bytes, on 8-byte places; plausible times (fixed values).
LEAF, TIME_FROM, TIME_TO = 48, 946_684_800, 2_147_483_647


def leaves_in(data: bytes, base: int, stop: int, disk: int) -> list[tuple]:
    """(channel, start, end, block_offset, at) of plausible index leaves that start before ``stop``."""
    out, at = [], 0
    while 0 <= (at := data.find(b"\xff" * 8, at)) < stop:
        if (base + at) % 8 or at + LEAF > len(data):
            at += 1
            continue
        start, end, place = *struct.unpack_from("<II", data, at + 0x18), struct.unpack_from("<Q", data, at + 0x20)[0]
        if TIME_FROM <= start <= end <= TIME_TO and 0 < place < disk:
            out.append((data[at + 0x11], start, end, place, base + at))
        at += 8
    return out


def index_leaves(blocks: DataFrame, disk: int, block: int = 1 << 30) -> DataFrame:
    """De-duplicated index records (channel, start, end, block_offset, at, copies, block) on the grid that most of them share."""

    def run(batches):
        for batch in batches:
            for offset, content, after in zip(*(c.to_pylist() for c in batch.columns)):
                rows = leaves_in(content + (after or b""), offset, len(content), disk)
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["channel", "start", "end", "block_offset", "at"])

    raw = blocks.select("offset", "content", "after").mapInArrow(run, "channel long, start long, end long, block_offset long, at long")
    residue = raw.groupBy((F.col("block_offset") % block).alias("r")).agg(F.count("*").alias("n"), F.min("at").alias("first")).agg(F.min_by("r", F.struct((-F.col("n")).alias("n"), "first")).alias("base"))
    on_grid = raw.crossJoin(F.broadcast(residue)).where(F.col("block_offset") % block == F.col("base"))
    by = on_grid.groupBy("channel", "start", "end", "block_offset", "base").agg(F.min("at").alias("at"), F.count("*").alias("copies"))
    return by.select("channel", "start", "end", "block_offset", "at", "copies", F.floor((F.col("block_offset") - F.col("base")) / block).cast("bigint").alias("block"))


#: Log records: marker, then version, time, major and minor (fixed values).
LOG_MARK, LOG_HEAD, LOG_MAJOR = b"RATS", "<4sIIHH", {1: "alarm", 2: "exception", 3: "operation", 4: "information"}
LOG_EVENT = {(3, 0x41): "power_on", (3, 0x42): "power_off", (3, 0x43): "abnormal_shutdown", (3, 0x5C): "format", (3, 0x82): "format"}


def log_records(blocks: DataFrame, init_time: int = 0) -> DataFrame:
    """(offset, t, major, minor, kind, bytes) of plausible log records; a record lasts until the next one."""
    size = struct.calcsize(LOG_HEAD)

    def run(batches):
        for batch in batches:
            for offset, content, after in zip(*(c.to_pylist() for c in batch.columns)):
                data, rows = content + (after or b""), []
                for m in re.finditer(re.escape(LOG_MARK), data):
                    if m.start() >= len(content) or m.start() + size > len(data):
                        break
                    _, version, t, major, minor = struct.unpack_from(LOG_HEAD, data, m.start())
                    if major in LOG_MAJOR and t >= init_time - 86_400 and t > TIME_FROM:
                        rows.append((offset + m.start(), t, major, minor, LOG_EVENT.get((major, minor), "user_action" if major == 3 else LOG_MAJOR[major])))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["offset", "t", "major", "minor", "kind"])

    found = blocks.select("offset", "content", "after").mapInArrow(run, "offset long, t long, major long, minor long, kind string")
    numbered = sequence.row_numbers(found, [], "offset", [], stretch=1 << 24)
    after = numbered.select((F.col("_n") - 1).alias("_n"), F.col("offset").alias("_next"))
    return numbered.join(after, "_n", "left").select("offset", "t", "major", "minor", "kind", (F.col("_next") - F.col("offset")).alias("bytes"))


def elementary_streams(units: DataFrame, gap: int = 4 << 20, least: int = LEAST) -> DataFrame:
    """Raw H.264/H.265 streams from start-code rows (volume, offset, codec, kind, key): a parameter set opens one, another set or a long gap ends it.

    kind is sps, slice, key or other; key names the parameter set. The last unit of a stream is left out, since where it ends is not known.
    """
    prev = sequence.with_previous(units, ["volume"], "offset", [], ["offset"], stretch=1 << 26)
    current = sequence.running_max(prev, ["volume"], "offset", [], F.when(F.col("kind") == "sps", F.struct("offset", "key")), "_set", stretch=1 << 26)
    opens = (F.col("kind") == "sps") & (F.col("_set").isNull() | (F.col("_set.key") != F.col("key")) | (F.col("offset") - F.col("prev_offset") > gap))
    broken = F.coalesce(F.col("offset") - F.col("prev_offset") > gap, F.lit(True))
    runs = sequence.runs(current, ["volume"], "offset", [], opens | broken, "stream", stretch=1 << 26)
    by = runs.groupBy("volume", "stream").agg(
        F.min_by("kind", "offset").alias("_first"), F.min_by("codec", "offset").alias("codec"), F.min_by("key", "offset").alias("sps_key"), (F.count("*") - 1).alias("units"), F.max("offset").alias("end"),
        F.count_if(F.col("kind").isin("slice", "key")).alias("slices"), F.count_if(F.col("kind") == "key").alias("keyframes"),
    )
    return by.where("_first = 'sps'").select("volume", "stream", "codec", "sps_key", "units", "slices", "keyframes", (F.col("end") - F.col("stream")).alias("bytes"), (F.col("slices") >= least).alias("kept"))


UNIT_SCHEMA = "volume long, offset long, codec string, kind string, key string, width int, height int"


def units_in(data: bytes, base: int, stop: int) -> list[tuple]:
    """(offset, codec, kind, key, width, height) of start codes before ``stop``; a parameter set lasts to the next start code, however long."""
    from ..functions.kernels import h264_picture, h265_picture

    rows, starts = [], [m.start() for m in re.finditer(b"\x00\x00\x01", data)]
    for at, end in zip(starts, [*starts[1:], len(data)]):
        if at >= stop or at + 5 > len(data):
            break
        h0, h1 = data[at + 3], data[at + 4]
        codec, kind, pic = "h264", "other", None
        if h0 & 0x9F == 7 and (pic := h264_picture(data[at + 3 : end])):
            kind = "sps"
        elif h0 >> 1 == 33 and h1 == 1 and (pic := h265_picture(data[at + 3 : end])):
            codec, kind = "h265", "sps"
        elif h0 & 0x9F in (1, 5) and h0 & 0x60:
            kind = "key" if h0 & 31 == 5 else "slice"
        elif h1 == 1 and not h0 & 0x81 and h0 >> 1 <= 21:
            codec, kind = "h265", "key" if 16 <= h0 >> 1 else "slice"
        rows.append((base + at, codec, kind, f"{codec}:{pic[4]}" if pic else None, *(pic[:2] if pic else (None, None))))
    return rows


def nal_units(blocks: DataFrame, volume: int = 0) -> DataFrame:
    """(volume, offset, codec, kind, key, width, height) of start codes; parameter sets are decoded, implausible ones are other."""
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())

    def run(batches):
        for batch in batches:
            for offset, content, after in zip(*(c.to_pylist() for c in batch.columns)):
                rows = units_in(content + (after or b""), offset, len(content))
                cols = list(zip(*rows)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array([volume] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types))], names=[c.split()[0] for c in UNIT_SCHEMA.split(", ")])

    return blocks.select("offset", "content", "after").mapInArrow(run, UNIT_SCHEMA)


def signature_hits(blocks: DataFrame, patterns: dict[str, bytes]) -> DataFrame:
    """(signature_id, offset) of byte patterns in blocks read with look-behind: a find that starts in the block before and ends in this one is reported here, once.

    Signatures with one pattern are all reported. Finds do not overlap within a block; where several patterns begin at
    one place the longest is found. Look-behind must be the longest pattern less one byte.
    """
    longest = max(map(len, patterns.values()))
    names: dict[bytes, list[str]] = {}
    for name, pattern in patterns.items():
        names.setdefault(pattern, []).append(name)
    union = re.compile(b"|".join(re.escape(p) for p in sorted(names, key=len, reverse=True)))

    def run(batches):
        for batch in batches:
            for offset, content, before in zip(*(c.to_pylist() for c in batch.columns)):
                tail = (before or b"")[-(longest - 1) :] if longest > 1 else b""
                data, out = tail + content, ([], [])
                for m in union.finditer(data):
                    if m.end() > len(tail):
                        out[0].extend(names[m[0]])
                        out[1].extend([offset - len(tail) + m.start()] * len(names[m[0]]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=["signature_id", "offset"])

    return blocks.select("offset", "content", "before").mapInArrow(run, "signature_id string, offset long")


#: Footage this much older than its cluster's span is older footage, not overflow, in seconds (fixed value).
REMNANT_AGE = 3600


def classified_frames(found: DataFrame, clusters: DataFrame, size: int, slack: int = 3) -> DataFrame:
    """Frames with the class of their place: own (inside the cluster's span, widened a little), spill (just outside it), remnant (an hour or more before it), or unassigned where no index slot holds the cluster.

    Clusters: (volume, cluster, start_s, end_s). The join is on the cluster's number; dates decide the class.
    """
    at = found.withColumn("cluster", F.floor(F.col("offset") / size).cast("bigint")).withColumn("t", F.floor(micros(packed_date(F.col("date"))) / 1_000_000).cast("bigint"))
    joined = at.join(clusters.select("volume", "cluster", "start_s", "end_s"), ["volume", "cluster"], "left")
    kind = (
        F.when(F.col("start_s").isNull() | F.col("t").isNull(), "unassigned").when(F.col("t").between(F.col("start_s") - slack, F.col("end_s") + slack), "own")
        .when(F.col("t") <= F.col("start_s") - REMNANT_AGE, "remnant").otherwise("spill")
    )
    return joined.withColumn("class", kind).drop("start_s", "end_s")


def remnants(classified: DataFrame, least: int = LEAST) -> DataFrame:
    """(volume, run, frames, first_s, last_s, bytes): runs of older footage of ``least`` frames or more; a frame of another class, or a step of over an hour, ends a run."""
    prev = sequence.with_previous(classified, ["volume"], "offset", [], ["class", "t"], stretch=1 << 26)
    breaks = (F.col("class") != F.col("prev_class")) | (F.abs(F.col("t") - F.col("prev_t")) > REMNANT_AGE)
    run = sequence.runs(prev, ["volume"], "offset", [], breaks, "run", stretch=1 << 26).where("class = 'remnant'")
    return run.groupBy("volume", "run").agg(F.count("*").alias("frames"), F.min("t").alias("first_s"), F.max("t").alias("last_s"), F.sum("length").alias("bytes")).where(F.col("frames") >= least)


def reassembled(classified: DataFrame, chains: DataFrame, least: int = 1) -> DataFrame:
    """(volume, head, frames, bytes, missing, extents): a file's own frames along its chain (volume, head, clusters), in chain order, repeats dropped; missing counts numbers between the video counter's ends that no frame has."""
    links = chains.select("volume", "head", F.posexplode("clusters").alias("place", "cluster"))
    own = classified.where("class = 'own'").join(links, ["volume", "cluster"])
    video = F.col("ftype").isin(*VIDEO)
    kept = sequence.not_repeated(own.withColumn("lane", F.concat_ws(":", "volume", "head", video.cast("string"))).withColumn("at", F.col("place") * (1 << 40) + F.col("offset")), ["lane"], "at", [], "frame_number", stretch=1 << 44)
    number = F.when(video, F.col("frame_number"))
    return kept.groupBy("volume", "head").agg(
        F.count("*").alias("frames"), F.sum("length").alias("bytes"), (F.max(number) - F.min(number) + 1 - F.countDistinct(number)).alias("missing"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "offset", "length"))), lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"))).alias("extents"),
    ).where(F.col("frames") >= least)


REJOINED = "volume long, cluster long, next long, offset long, ftype int, frame_number long, length long, date long, ms int, head_length long, sha256 string, content binary"


def rejoined_frames(clusters: DataFrame, links: DataFrame, classified: DataFrame, size: int) -> DataFrame:
    """Frames cut at a cluster's end and finished at the start of the next cluster of their chain (REJOINED rows).

    Clusters: (volume, cluster, content), each whole. Links: (volume, cluster, next); a next that lies behind the cluster
    on the disk needs no joining. ``classified``: frames with their cluster and class; the write is in order, so the cut
    frame begins where the cluster's last own frame ends. Its two parts, the tail of one cluster and the head of another,
    meet by the number of the next one; they must make a sound frame that follows the last one, without a frame's mark
    in its second part, which would be another camera's write over it.
    """
    dated = F.floor(micros(packed_date(F.col("date"))) / 1_000_000).cast("bigint")
    kind = F.when(F.col("ftype").isin(*VIDEO), 0).when(F.col("ftype") == 0xF0, 1).otherwise(2)
    own = classified.where("class = 'own'").select("volume", "cluster", "offset", "length", "frame_number", "ms", dated.alias("seconds"), kind.alias("kind"))
    newest = [F.max_by("frame_number", F.when(F.col("kind") == k, F.col("offset"))).alias(f"newest_{k}") for k in range(len(KINDS))]
    ends = own.groupBy("volume", "cluster").agg(F.max(F.struct("offset", "length", "ms", "seconds")).alias("last"), *newest)
    at = F.col("last.offset") + F.col("last.length")
    cut = ends.join(links.where("next <> cluster + 1"), ["volume", "cluster"]).where(at < (F.col("cluster") + 1) * size)
    tails = clusters.join(cut, ["volume", "cluster"]).select(*cut.columns, at.alias("at"), F.expr(f"substring(content, cast(last.offset + last.length - cluster * {size} as int) + 1)").alias("tail"))
    tails = tails.where(F.substring("tail", 1, len(FRAME)) == F.substring(F.lit(FRAME), F.lit(1), F.least(F.octet_length("tail"), F.lit(len(FRAME)))))
    heads = clusters.join(tails.select("volume", F.col("next").alias("cluster")).distinct(), ["volume", "cluster"], "left_semi").select("volume", F.col("cluster").alias("next"), F.substring("content", 1, LARGEST).alias("head"))
    names = ["volume", "cluster", "next", "at", "tail", "head", "last", *(f"newest_{k}" for k in range(len(KINDS)))]
    types = (*[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.string(), pa.binary())

    def run(batches):
        for batch in batches:
            rows = []
            for volume, cluster, next_, at, tail, head, last, *newest in zip(*(c.to_pylist() for c in batch.columns)):
                start = (tail + head[:HEADER])[:HEADER]
                length = int.from_bytes(start[12:16], "little") if len(start) == HEADER else 0
                if not len(tail) < length <= LARGEST:
                    continue
                data = tail + head[: length - len(tail)]
                frame = sound_frame(data, 0)
                second = data[len(tail) : length - TAIL]
                if frame is None or FRAME in second or TRAILER in second:
                    continue
                which = 0 if frame[0] in VIDEO else 1 if frame[0] == 0xF0 else 2
                streams = Streams()
                streams.open[0] = {"offset": last["offset"], "ms": last["ms"], "seconds": last["seconds"], "newest": newest}
                if streams.distance(0, {"ms": frame[4], "seconds": seconds_of(frame[3]), "kind": which, "frame_number": frame[1]}) is not None:
                    rows.append((volume, cluster, next_, at, frame[0], frame[1], frame[2], frame[3], frame[4], len(tail), hashlib.sha256(data).hexdigest(), data))
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [c.split()[0] for c in REJOINED.split(", ")])

    return tails.join(heads, ["volume", "next"]).select(*names).mapInArrow(run, REJOINED)


def seconds_of(date: int) -> int | None:
    """Seconds since 1970 of a packed date; None if it is none."""
    try:
        return int(datetime((date >> 26 & 63) + 2000, date >> 22 & 15, date >> 17 & 31, date >> 12 & 31, date >> 6 & 63, date & 63, tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def with_overflow(classified: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """Frames with class overflow, and ``home``, where a write ran over its cluster's end: what touches the frame across the border, one frame after the other, belongs to the cluster before, unless that one's chain goes on here."""
    prev = sequence.with_previous(classified, ["volume"], "offset", [], ["offset", "length", "ms", "t"], stretch=1 << 26)
    on = F.pmod(F.col("ms") - F.col("prev_ms") + 0x8000, F.lit(0x10000)) - 0x8000
    follows = (F.col("prev_offset") + F.col("prev_length") == F.col("offset")) & on.between(-MS_BACK, MS_ON) & (F.col("t") - F.col("prev_t")).between(-DATE_BACK, DATE_ON)
    begins = F.floor((F.col("offset")) / size) != F.floor(F.col("prev_offset") / size)  # the first frame of a cluster
    entered = F.when(~follows | begins, F.struct("offset", (follows & begins & (F.col("prev_offset") + F.col("prev_length") > F.col("cluster") * size)).alias("over")))
    run = sequence.running_max(prev, ["volume"], "offset", [], F.when(F.col("prev_offset").isNull(), F.struct("offset", F.lit(False).alias("over"))).otherwise(entered), "_in", inclusive=True, stretch=1 << 26)
    before = links.select("volume", (F.col("cluster") + 1).alias("cluster"), F.col("next").alias("_next"))
    over = F.col("_in.over") & (F.coalesce("_next", F.lit(0)) != F.col("cluster"))
    out = run.join(before, ["volume", "cluster"], "left")
    return out.select(*[c for c in classified.columns if c != "class"], F.when(over, "overflow").otherwise(F.col("class")).alias("class"), F.when(over, F.col("cluster") - 1).otherwise(F.col("cluster")).alias("home"))
