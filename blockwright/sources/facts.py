"""One pass over an image to facts: the block map, headers found inside the reader, ordered hashes, and clips out again.

What a later step needs of a block is a row, not its bytes: the block map is written once and read by classes,
coverage, differences and proofs. Headers are found where the bytes are read, so that only headers leave the reader.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carve
from . import images, taps

def open_image(path: str):
    return images.EwfImage(path) if path[-3:-2].lower() == "e" and path[-2:].isdigit() else images.RawImage(path)


def _tapped(spark: SparkSession, path: str, tap: taps.Tap, block: int, per_task: int) -> DataFrame:
    """Rows of one tap alone, straight from the reader; its failure is the job's."""

    def sound(tap_, at, reason):
        return F.when(reason.isNotNull(), F.raise_error(F.concat_ws(" ", tap_, F.lit("failed at"), at.cast("string"), reason)).cast("boolean")).otherwise(True)

    rows = taps.scan_rows(spark, path, [tap], block, per_task)
    return rows.where(sound(F.col("tap"), F.col("failed_at"), F.col("reason"))).select(f"`{tap.name}`.*")


def block_map(spark: SparkSession, path: str, block: int = 8 << 20, per_task: int = 8) -> DataFrame:
    """Rows of every block (``taps.BlockFacts``). A sector that cannot be read is zero in the facts and marks its block bad."""
    return _tapped(spark, path, taps.BlockFacts(block), block, per_task)


def frames(spark: SparkSession, path: str, block: int = 8 << 20, per_task: int = 8) -> DataFrame:
    """Valid camera frames of an image, found inside the reader; the same rows as ``carve.frames`` over its blocks."""
    return carve.unnested(_tapped(spark, path, taps.Frames(), block, per_task))


def packs(spark: SparkSession, path: str, block: int = 8 << 20, per_task: int = 8) -> DataFrame:
    """Valid packs of an image, found inside the reader; the same rows as ``carve.packs`` over its blocks."""
    return carve.unnested(_tapped(spark, path, taps.Packs(), block, per_task))


def whole_hashes(spark: SparkSession, path: str, block: int = 8 << 20) -> DataFrame:
    """(md5, sha1, sha256, bytes, complete) of the whole image in order: one task by nature, so it is a job of its own."""

    def run(batches):
        image = open_image(path)
        sums = [hashlib.new(n) for n in ("md5", "sha1", "sha256")]
        seen = 0
        for _ in batches:
            pass
        for at in range(0, image.size, block):
            data = image.read(at, block)
            seen += len(data)
            for s in sums:
                s.update(data)
        yield pa.RecordBatch.from_arrays([*(pa.array([s.hexdigest()]) for s in sums), pa.array([seen], pa.int64()), pa.array([seen == image.size])], names=["md5", "sha1", "sha256", "bytes", "complete"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "md5 string, sha1 string, sha256 string, bytes long, complete boolean")


def write_clips(streams: DataFrame, path: str, folder: str, id_col: str, extents_col: str, suffix: str) -> DataFrame:
    """(id, file, bytes, sha256) of clips written from the image's extents, each re-read and hashed; one file for each stream.

    ``folder`` is one that all executors share. A clip is written under a name of the task's attempt and then renamed,
    so an attempt that is lost leaves no half file under the clip's name.
    """

    def run(batches):
        from pyspark import TaskContext

        image, attempt = open_image(path), TaskContext.get().taskAttemptId()
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for name, extents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = os.path.join(folder, f"{name}{suffix}")
                total, digest = 0, hashlib.sha256()
                with open(f"{target}.{attempt}", "wb") as f:
                    for e in extents:
                        for at in range(e["offset"], e["offset"] + e["length"], 8 << 20):
                            data = image.read(at, min(8 << 20, e["offset"] + e["length"] - at))
                            f.write(data)
                            digest.update(data)
                            total += len(data)
                os.replace(f"{target}.{attempt}", target)
                rows.append((str(name), target, total, digest.hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["id", "file", "bytes", "sha256"])

    return streams.select(F.col(id_col).cast("string"), extents_col).mapInArrow(run, "id string, file string, bytes long, sha256 string")


def preserved(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks (of a block map) that regions (name, start, end) touch, each once, with the names; ready for proofs by index."""
    size = F.lit(blocks.agg(F.max("length")).first()[0] or 1)
    hit = regions.where("end > start").select("name", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("index"))
    names = hit.groupBy("index").agg(F.array_sort(F.collect_set("name")).alias("regions"))
    return blocks.join(names, "index")


def canonical(row: dict) -> str:
    """JSON with sorted keys and no blanks: what ledgers and contracts hash."""
    return json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Ledger:
    """A custody ledger as JSON lines, appended by one writer on the driver; each entry names the hash of the one before."""

    def __init__(self, path: str):
        self.path = path

    def entries(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip()]

    def append(self, action: str, detail: dict, actor: str, ts_utc: str, data_hash: str = "") -> dict:
        before = self.entries()
        entry = {"seq": len(before), "ts_utc": ts_utc, "actor": actor, "action": action, "detail": detail, "data_hash": data_hash, "prev_hash": before[-1]["entry_hash"] if before else "0" * 64}
        entry["entry_hash"] = hashlib.sha256(canonical(entry).encode()).hexdigest()
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(canonical(entry) + "\n")
        return entry

    def first_break(self) -> tuple[int, str] | None:
        """(place, reason) of the first entry that is not as it was written, or None."""
        prior = "0" * 64
        for k, e in enumerate(self.entries()):
            own = {x: v for x, v in e.items() if x != "entry_hash"}
            for bad, why in ((e.get("seq") != k, "sequence"), (e.get("prev_hash") != prior, "link"), (hashlib.sha256(canonical(own).encode()).hexdigest() != e.get("entry_hash"), "content")):
                if bad:
                    return k, why
            prior = e["entry_hash"]
        return None

    def seal(self, key: bytes) -> str:
        """A keyed sum over the number of entries and the last hash: an end that is cut off shows."""
        import hmac

        e = self.entries()
        return hmac.new(key, f"{len(e)}|{e[-1]['entry_hash'] if e else ''}".encode(), hashlib.sha256).hexdigest()
