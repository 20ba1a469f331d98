"""Removal of long repeated strings by sharded suffix arrays.

A whole corpus has no one suffix array that a task could hold, so it is cut into shards that together see every pair of
equal windows (strings of ``LENGTH`` bytes):

1. Every window is named by its least gram of ``GRAM`` bytes (by hash). Equal windows have the same least gram at the
   same place. Consecutive windows of one least gram form a run: one small row for about 140 bytes of text. Runs whose
   gram occurs once in the corpus hold no repeat and go no further.
2. The stretch of text under each run that is left goes to its gram's shard; of equal stretches a shard sorts one and
   knows that there are more. A gram with more different stretches than a shard may hold is divided: its windows' range
   of places is halved, and each half gets a longer common string as its key, down to single windows, whose stretches
   are equal when their keys are. No stretch is left out or cut short.
3. Shards are sorted by induction and their permuted common prefixes computed (``suffixes``); a window that shares
   ``LENGTH`` bytes with a neighbour in the suffix array is a repeat.
4. The runs of bytes so found go back to the texts that hold the stretches.

Texts move once, those that hold a run twice. Everything between is written to the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, text_or_empty, text_runs, tidy
from .suffixes import anchored, repeated_runs

#: Bytes of a string that may occur once only, and of the grams that name its windows.
LENGTH, GRAM = 400, 128
#: Bytes of texts read, of stretches sorted together, and of different stretches of one gram in a shard.
READ_BYTES, SHARD_BYTES, GROUP_BYTES = 4 << 20, 1 << 20, 1 << 19
#: Stretches that are handed out in one batch.
STRETCHES_AT_ONCE = 1 << 12
#: Names that a task remembers so as not to hand the same text or stretch out again; it starts anew beyond.
REMEMBERED = 1 << 16

RUNS = "uid binary, lo int, hi int, at int, key bigint"
STRETCHES = "uid binary, text binary, key bigint, seg binary, lo int, hi int, at int, u int, v int, bytes binary"
PARTS = "pkey bigint, pseg binary, off int, key bigint, seg binary, hi int, at int, u int, v int, bytes binary"
FOUND = "key bigint, seg binary, spans array<struct<s:int,e:int>>"


def _stored(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written to the shared folder; a lost executor costs nothing that was written."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _named(documents: DataFrame) -> DataFrame:
    """(uid, text) of the texts that are long enough to hold a window."""
    text = text_or_empty()
    return documents.select(F.unhex(F.md5(text.cast("binary"))).alias("uid"), text.cast("binary").alias("text")).where(F.octet_length("text") >= LENGTH)


@tidy
def _runs_of(batches):
    for batch in batches:
        for part in text_runs(batch, 1, READ_BYTES):
            texts = part.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            text, lo, hi, at, key = anchored(data, offsets - offsets[0], LENGTH, GRAM)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), *(pc.cast(pa.array(x), pa.int32()) for x in (lo, hi, at - lo)), pa.array(key)], ["uid", "lo", "hi", "at", "key"])


@tidy
def _once_a_task(batches):
    """Rows whose name was not met in this task yet."""
    met: set = set()
    for batch in batches:
        keep = []
        for uid in batch.column(0).to_pylist():
            keep.append(uid not in met)
            met.add(uid)
        if len(met) > REMEMBERED:
            met.clear()
        yield batch.filter(pa.array(keep))


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], [n for n, _ in schema])


_STRETCH = [("uid", pa.binary()), ("text", pa.binary()), ("key", pa.int64()), ("seg", pa.binary()), *((n, pa.int32()) for n in ("lo", "hi", "at", "u", "v")), ("bytes", pa.binary())]
_PART = [("pkey", pa.int64()), ("pseg", pa.binary()), ("off", pa.int32()), ("key", pa.int64()), ("seg", pa.binary()), *((n, pa.int32()) for n in ("hi", "at", "u", "v")), ("bytes", pa.binary())]


def _segment(at: int, data: bytes) -> bytes:
    """Name of a stretch with its gram's place."""
    return hashlib.md5(b"%d:" % at + data).digest()


@tidy
def _cut_out(batches):
    """The stretch under each run of a text, its bytes for the first two of its kind in this task, and the text itself."""
    met: dict = {}
    names = [n for n, _ in _STRETCH]
    for batch in batches:
        n, texts = batch.num_rows, batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.nulls(n, t) for _, t in _STRETCH[2:])], names)
        flat = batch.column(2).flatten()
        lo, hi, at, key, w = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        owner = np.repeat(np.arange(n), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        for first in range(0, len(lo), STRETCHES_AT_ONCE):
            index, segs, parts = [], [], []
            part = slice(first, first + STRETCHES_AT_ONCE)
            for k, (o, a, b, p, g, c) in enumerate(zip(*(x[part].tolist() for x in (owner, lo, hi, at, key, w)), strict=True), first):
                data = texts[o][a : b + LENGTH]
                seg = _segment(p, data)
                seen = met.get((g, seg), 0)
                copies = max(0, min(2, seen + c) - seen)
                if copies:
                    met[g, seg] = seen + copies
                for j in range(copies or 1):
                    index.append(k)
                    segs.append(seg)
                    parts.append(data if j < copies else None)
            got, m = pa.array(index, pa.int64()), len(index)
            low, high = lo[index], hi[index]
            columns = [batch.column(0).take(pa.array(owner[index])), pa.nulls(m, pa.binary()), flat.field(3).take(got), pa.array(segs, pa.binary()), pa.array(low), pa.array(high - low), flat.field(2).take(got), pa.array(np.full(m, GRAM - LENGTH, np.int32)), pa.array(np.zeros(m, np.int32)), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
        if len(met) > REMEMBERED:
            met.clear()


@tidy
def _halved(batches):
    """Each stretch as the stretches of the two halves of its windows' places, under their longer common strings."""
    for batch in batches:
        rows = []
        for key, seg, last, at, u, v, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle = (u + v) // 2
            for a, b in ((u, middle), (middle + 1, v)):
                lo, hi = max(0, at + a), min(last, at + b)  # window starts, counted from the stretch's first
                if a <= b and lo <= hi:
                    part, place = data[lo : hi + LENGTH], at - lo
                    common = part[place + b : place + a + LENGTH]
                    name = int.from_bytes(hashlib.blake2b(b"%d:%d:" % (a, b) + common, digest_size=8).digest(), "little", signed=True)
                    rows.append((key, seg, lo, name, _segment(place, part), hi - lo, place, a, b, part))
        yield _table(rows, _PART)


def _sorted_shards(limit: int):
    """Shards of whole grams, in the order in which they come; repeated runs of each kind of stretch.

    The only kind of a gram meets no other: its windows have the gram at different places, so they differ, and it is
    repeated whole if it came more than once. It is not sorted.
    """

    def shard(held: dict, alone: list[tuple]) -> pa.RecordBatch:
        found = repeated_runs([data for data, _ in held.values()], LENGTH) if held else []
        found = [[(0, len(data))] if many else runs for (data, many), runs in zip(held.values(), found, strict=True)]
        rows = alone + [(key, seg, [{"s": s, "e": e} for s, e in runs]) for (key, seg), runs in zip(held, found, strict=True) if runs]
        return _table(rows, [("key", pa.int64()), ("seg", pa.binary()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    @tidy
    def run(batches):
        held: dict = {}  # a kind's bytes, and whether it came more than once
        own: dict = {}  # the same of the gram at hand
        alone: list[tuple] = []
        size, now = 0, None

        def close() -> int:
            """Puts the gram's kinds where they belong; the bytes that are to be sorted."""
            if len(own) > 1:
                held.update(own)
                return sum(len(data) for data, _ in own.values())
            alone.extend((key, seg, [{"s": 0, "e": len(data)}]) for (key, seg), (data, many) in own.items() if many)
            return 0

        for batch in batches:
            for key, seg, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    size += close()
                    own = {}
                    if size >= limit or len(alone) >= STRETCHES_AT_ONCE:
                        yield shard(held, alone)
                        held, alone, size = {}, [], 0
                now = key
                own[key, seg] = (data, (key, seg) in own)
        close()
        if held or alone:
            yield shard(held, alone)

    return run


def _repeats(stretches: DataFrame, group_bytes: int, shard_bytes: int) -> DataFrame:
    """(key, seg, spans): runs of bytes, from the stretch's first, that lie in repeated windows."""
    kinds = stretches.groupBy("key", "seg").agg(F.max("hi").alias("hi")).groupBy("key").agg(F.sum(F.col("hi") + LENGTH).alias("size"))
    large = kinds.where(F.col("size") > group_bytes).select(F.col("key").alias("large"))
    given = stretches.where("bytes is not null")
    small, parts = given, None
    if not large.isEmpty():
        large = _stored(large, "large")
        small = given.join(large, F.col("key") == F.col("large"), "left_anti")
        whole = given.join(large, F.col("key") == F.col("large"), "left_semi").select("key", "seg", "hi", "at", "u", "v", "bytes")
        parts = _stored(whole.mapInArrow(_halved, PARTS), "halves")
    dealt = small.select("key", "seg", "bytes").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_sorted_shards(shard_bytes), FOUND)
    if parts is not None:
        below = _repeats(parts, group_bytes, shard_bytes)
        links = parts.select("pkey", "pseg", "off", "key", "seg").distinct()
        back = links.join(below, ["key", "seg"]).select(F.col("pkey").alias("key"), F.col("pseg").alias("seg"), F.explode("spans").alias("x"), "off")
        back = back.select("key", "seg", F.struct((F.col("x.s") + F.col("off")).alias("s"), (F.col("x.e") + F.col("off")).alias("e")).alias("x"))
        found = found.unionByName(back.groupBy("key", "seg").agg(F.collect_set("x").alias("spans")))
    return _stored(found, "repeats")


@tidy
def _without(batches):
    """What is left of each text, given the runs to remove."""
    for batch in batches:
        rows = []
        for uid, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            merged: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            kept, left = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(text[left:s])
                left = e
            kept.update(text[left:])
            rows.append((uid, sum(e - s for s, e in merged), len(merged), kept.hexdigest(), [{"s": s, "e": e} for s, e in merged]))
        yield _table(rows, [("uid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])


def remove_repeats(documents: DataFrame, group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES, id: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed): one row for each document, in bytes of UTF-8.

    ``removed`` has the runs of bytes, first and past the last, that strings of LENGTH bytes cover which start at another
    place too, in this text or another; ``kept_sha256`` is the digest of what is left. Equal texts count as two, whatever
    their ids, and so lose everything once they hold a window; overlapping occurrences count. Null and empty texts, and
    texts below LENGTH bytes, lose nothing. Repeated and null ids are rows of their own. A very long text is read whole
    and is one row of the last step. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    texts = _named(documents)
    runs = _stored(texts.mapInArrow(_runs_of, RUNS), "runs")
    twice = runs.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c")).where("c > 1").select("k")
    twice = _stored(twice, "twice")  # a fresh table, so that a join with a hot gram may be split
    live = runs.join(twice, F.col("key") == F.col("k")).groupBy("uid", "lo", "hi", "at", "key").agg(F.count("*").alias("w"))
    owners = live.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "at", "key", F.least("w", F.lit(2)).alias("w"))).alias("runs"))
    held = texts.mapInArrow(_once_a_task, "uid binary, text binary").join(owners.hint("shuffle_hash").withColumnRenamed("uid", "owner"), F.col("uid") == F.col("owner")).select("uid", "text", "runs")
    stretches = _stored(held.mapInArrow(_cut_out, STRETCHES), "stretches")
    pieces = stretches.where("text is null")
    found = _repeats(pieces.select("key", "seg", "hi", "at", "u", "v", "bytes"), group_bytes, shard_bytes)
    spans = pieces.select("uid", "lo", "key", "seg").distinct().join(found, ["key", "seg"]).select("uid", F.transform("spans", lambda x: F.struct((x["s"] + F.col("lo")).alias("s"), (x["e"] + F.col("lo")).alias("e"))).alias("x"))
    spans = spans.groupBy("uid").agg(F.flatten(F.collect_list("x")).alias("spans"))
    whole = stretches.where("text is not null").select(F.col("uid").alias("owner"), "text").join(spans.hint("shuffle_hash"), F.col("owner") == F.col("uid"))
    results = whole.select("uid", "text", "spans").mapInArrow(_without, "uid binary, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<s:bigint,e:bigint>>").dropDuplicates(["uid"])
    results = _stored(results, "kept")
    text = text_or_empty().cast("binary")
    rows = documents.select(F.col(id).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.unhex(F.md5(text)).alias("name"), F.sha2(text, 256).alias("whole"))
    out = rows.join(results, F.col("name") == F.col("uid"), "left")
    none = F.lit(0).cast("bigint")
    return out.select("id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("removed"))
