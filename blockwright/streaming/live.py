"""Streaming forms: windowed activity, sessions, and an ordered carve with state.

The disk offset is the time of a stream of blocks: blocks come in order, a watermark on offsets closes what has gone
quiet, and a block that comes too late is told, not silently dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.carve import CLOCK_JUMP, LEAST


def activity(events: DataFrame, ts: str, lane: str, value: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(lane, start, n, total) of tumbling windows; rows later than the watermark are left out."""
    w = events.withWatermark(ts, late).groupBy(lane, F.window(ts, every).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(lane, F.col("w.start").alias("start"), "n", "total")


def sliding(events: DataFrame, ts: str, lane: str, value: str, size: str = "10 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(lane, F.window(ts, size, step).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(lane, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, ts: str, lane: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(lane, start, last, n): runs of rows no further apart than the gap (a distance of exactly the gap still joins)."""
    w = events.withWatermark(ts, late).groupBy(lane, F.session_window(ts, gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(lane, F.col("w.start").alias("start"), "last", "n")


PACK_STATE = "start long, until long, scr long, packs long, bytes long"
PACK_OUT = "volume long, stream long, packs long, bytes long, kept boolean"


def _split(state, offset: int, length: int, scr: int):
    """(finished stream or None, next state) when a pack comes."""
    if state is not None:
        start, until, last, packs, size = state
        step = (scr - last + (1 << 32)) % (1 << 33) - (1 << 32)
        if until == offset and abs(step) <= CLOCK_JUMP:
            return None, (start, offset + length, scr, packs + 1, size + length)
        return (start, packs, size), (offset, offset + length, scr, 1, length)
    return None, (offset, offset + length, scr, 1, length)


def pack_streams(packs: DataFrame) -> DataFrame:
    """Streams of packs (volume, offset, length, scr), as they end; a stream that is still open stays in the state.

    Packs of one volume must come in order across batches. One that lies before the volume's high-water mark fails the
    query, so that no footage is lost in silence.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        out = []
        for pdf in [pd.concat(list(frames))]:
            for offset, length, scr in pdf.sort_values("offset")[["offset", "length", "scr"]].itertuples(index=False, name=None):
                if held is not None and offset < held[1]:
                    raise ValueError(f"volume {key[0]}: a pack at {offset} came after {held[1]} was reached")
                done, held = _split(held, int(offset), int(length), int(scr))
                if done:
                    out.append((key[0], done[0], done[1], done[2], done[1] >= LEAST))
        state.update(held)
        yield pd.DataFrame(out, columns=["volume", "stream", "packs", "bytes", "kept"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return packs.groupBy("volume").applyInPandasWithState(run, PACK_OUT, PACK_STATE, "append", GroupStateTimeout.NoTimeout)


class HighWater(StatefulProcessor):
    """Per key, the rows seen and the greatest value so far, kept in the state store; each batch tells the key's new state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long, top double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, top = self.held.get() if self.held.exists() else (0, float("-inf"))
        for pdf in rows:
            n, top = n + len(pdf), max(top, float(pdf["value"].max()))
        self.held.update((n, top))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "top": [top]})

    def close(self) -> None:
        pass


def high_water(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, top) per batch and key."""
    return rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).groupBy("key").transformWithStateInPandas(HighWater(), f"key {dict(rows.dtypes)[key]}, n long, top double", "Update", "None")


#: Bytes of silence after which a volume's stream is retired from the state.
SILENCE = 256 << 20
RETIRED = "volume long, stream long, packs long, bytes long, kept boolean, why string"


class Retiring(StatefulProcessor):
    """The open stream of a volume, kept until it breaks or until the disk has gone on for SILENCE bytes.

    The offset is event time, a millisecond a byte: timers fire when the watermark on offsets passes them, so a stream
    ends without another pack of its volume, and its state goes with it. A pack that lies before the volume's high-water
    mark is told as ``late``, and is in no stream.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", PACK_STATE)

    def _told(self, volume, done, why):
        return (volume, done[0], done[1], done[2], done[1] >= LEAST, why)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = (tuple(self.held.get()) if self.held.exists() else None), []
        for offset, length, scr in pd.concat(list(rows)).sort_values("offset")[["offset", "length", "scr"]].itertuples(index=False, name=None):
            if held is not None and offset < held[1]:
                out.append((key[0], int(offset), 1, int(length), False, "late"))
                continue
            if held is not None and offset - held[1] > SILENCE:
                out.append(self._told(key[0], (held[0], held[3], held[4]), "silence"))
                held = None
            done, held = _split(held, int(offset), int(length), int(scr))
            if done:
                out.append(self._told(key[0], done, "break"))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is not None:
            self.held.update(held)
            self.handle.registerTimer(held[1])  # the watermark follows SILENCE bytes behind
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RETIRED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            start, _, _, packs, size = self.held.get()
            out.append(self._told(key[0], (start, packs, size), "silence"))
            self.held.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RETIRED.split(", ")])

    def close(self) -> None:
        pass


def retiring_streams(packs: DataFrame) -> DataFrame:
    """(volume, stream, packs, bytes, kept, why) of packs (volume, offset, length, scr), as streams end: by a break, by SILENCE bytes of the disk without one of theirs, or ``late`` ones.

    The watermark follows SILENCE bytes behind the greatest offset of all volumes (and begins at 0, so offset 0 is a
    millisecond later). Rows that come even later than that
    belong to streams that are closed; Spark leaves them out and counts them in the query's progress.
    """
    timed = packs.withColumn("at", F.timestamp_millis(F.col("offset") + 1)).withWatermark("at", f"{SILENCE} milliseconds")
    return timed.groupBy("volume").transformWithStateInPandas(Retiring(), RETIRED, "Append", "EventTime")
