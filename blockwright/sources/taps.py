"""One read of an image for all tasks: taps see every block once, and their rows leave the reader together.

A tap has a name, the fields of its rows, the bytes that it needs after a block, and three steps: ``begin(image)`` at the
start of a task, ``update(state, base, data, own)`` for each block (``data`` goes on for ``ahead`` bytes past the ``own``
ones), and ``finish(state)`` at the end of a task. ``update`` and ``finish`` return columns of rows.

The scan is one ``mapInArrow`` job whose rows are written once, a folder for each tap, and read apart afterwards. A tap
that fails is dropped by its task and tells where; the other taps and the scan go on. A tap of which a task failed is not
complete, and ``rows`` refuses it unless asked.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import kernels
from ..operators import carve, store
from . import images


class Tap:
    """A tap without rows; others override its steps."""

    name, schema, ahead = "tap", "offset long", 0

    def begin(self, image):
        return None

    def update(self, state, base: int, data: bytes, own: int, bad: bool) -> list:
        return []

    def finish(self, state) -> list:
        return []


class BlockFacts(Tap):
    """The block map: hash, density and census of every block."""

    name, schema = "map", "index long, offset long, length int, sha256 string, incompressibility double, start_codes long, sps long, pps long, idr long, hevc_ps long, bad boolean"

    def __init__(self, block: int):
        self.block = block

    def update(self, state, base, data, own, bad):
        data = data[:own]
        return [[x] for x in (base // self.block, base, own, hashlib.sha256(data).hexdigest(), kernels.incompressibility(data), kernels.start_codes(data), *kernels.census(data), bad)]


class Frames(Tap):
    """Camera frames, those inside others too."""

    name, schema, ahead = "frames", carve.FRAME_SCHEMA, carve.LARGEST

    def update(self, state, base, data, own, bad):
        rows = carve.frames_in(data, base, own, nested=True)
        return [[0] * len(rows), *map(list, zip(*rows))] if rows else []


class Packs(Tap):
    """Packs of program streams, those inside others too."""

    name, schema, ahead = "packs", carve.PACK_SCHEMA, carve.PACK_AHEAD

    def begin(self, image):
        return image.size

    def update(self, state, base, data, own, bad):
        cols = carve.packs_in(data, base, own, base + len(data) >= state)
        return [[0] * len(cols[0]), *cols]


class Units(Tap):
    """Start codes and decoded parameter sets of raw video."""

    name, schema, ahead = "units", carve.UNIT_SCHEMA, 1 << 16

    def update(self, state, base, data, own, bad):
        rows = carve.units_in(data, base, own)
        return [[0] * len(rows), *map(list, zip(*rows))] if rows else []


def all_taps(block: int) -> list[Tap]:
    return [BlockFacts(block), Frames(), Packs(), Units()]


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _form(taps: list[Tap]) -> str:
    return ", ".join(["tap string", "failed_at long", "reason string", *(f"`{t.name}` struct<{', '.join(':'.join(c.split()) for c in t.schema.split(', '))}>" for t in taps)])


def scan_rows(spark: SparkSession, path: str, taps: list[Tap], block: int = 8 << 20, per_task: int = 8, numbers: DataFrame | None = None) -> DataFrame:
    """Tagged rows of all taps from one read: (tap, failed_at, reason, one struct for each tap). ``numbers``: the blocks to read (id), in tasks by range; else all."""
    from .facts import open_image

    form = _form(taps)
    schema, own_schemas = _arrow(form), [_arrow(t.schema) for t in taps]
    most = max((t.ahead for t in taps), default=0)

    def run(batches):
        image = open_image(path)
        states: dict[int, object] = {}
        dead: set[int] = set()

        def told(k: int, cols: list) -> pa.RecordBatch | None:
            if not cols or not len(cols[0]):
                return None
            n = len(cols[0])
            row = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, own_schemas[k])], fields=list(own_schemas[k]))
            rest = [row if j == k else pa.nulls(n, schema.field(3 + j).type) for j in range(len(taps))]
            return pa.RecordBatch.from_arrays([pa.array([taps[k].name] * n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *(a.cast(schema.field(3 + j).type) for j, a in enumerate(rest))], schema=schema)

        def guarded(k: int, at: int, step):
            """The step's rows; a tap that raises is off for the rest of the task."""
            if k in dead:
                return None
            try:
                return told(k, step())
            except Exception as e:  # noqa: BLE001  whatever a tap does, the scan goes on
                dead.add(k)
                return pa.RecordBatch.from_arrays([pa.array([taps[k].name]), pa.array([at]), pa.array([f"{type(e).__name__}: {e}"]), *(pa.nulls(1, schema.field(3 + j).type) for j in range(len(taps)))], schema=schema)

        def begin(k: int):
            states[k] = taps[k].begin(image)
            return []

        held: dict[int, tuple[bytes, bool]] = {}

        def piece(n: int) -> tuple[bytes, bool]:
            if n not in held:
                held[n] = images._Reader._whole(image, n * block, min(block, image.size - n * block))[:2]
            return held[n]

        def after(n: int, mine: set[int]) -> bytes:
            """Bytes past a block: of the task's own next blocks, which it holds from then on, and at its end of another read."""
            out, at, need = [], (n + 1) * block, min(most, image.size - (n + 1) * block)
            while need > 0:
                data = piece(at // block)[0] if at // block in mine else images._Reader._whole(image, at, need)[0]
                out.append(data[:need])
                need -= len(out[-1])
                at += len(data)
            return b"".join(out)

        at = 0
        for k in range(len(taps)):
            if (out := guarded(k, 0, lambda k=k: begin(k))) is not None:
                yield out
        for batch in batches:
            mine = set(batch.column(0).to_pylist())
            for n in sorted(mine):
                at = n * block
                own, bad = piece(n)
                more = after(n, mine)
                del held[n]
                for k, tap in enumerate(taps):
                    if (out := guarded(k, at, lambda k=k, tap=tap: tap.update(states[k], at, own + more[: tap.ahead] if tap.ahead else own, len(own), bad))) is not None:
                        yield out
        for k, tap in enumerate(taps):
            if (out := guarded(k, at, lambda k=k, tap=tap: tap.finish(states[k]))) is not None:
                yield out

    size = open_image(path).size
    blocks = -(-size // block)
    asked = spark.range(0, blocks, 1, max(1, -(-blocks // per_task))) if numbers is None else numbers
    return asked.mapInArrow(run, form)


class Scan:
    """The written rows of one shared read."""

    def __init__(self, spark: SparkSession, folder: str, taps: list[Tap]):
        self.spark, self.folder, self.taps = spark, folder, {t.name: t for t in taps}

    def _table(self) -> DataFrame:
        return self.spark.read.schema(_form(list(self.taps.values()))).parquet(self.folder)

    def failures(self) -> DataFrame:
        """(tap, failed_at, reason): where a task dropped a tap."""
        return self._table().where("reason is not null").select("tap", "failed_at", "reason")

    def rows(self, name: str, partial: bool = False) -> DataFrame:
        """A tap's rows. Those of a tap that failed somewhere are not complete: an error unless ``partial``."""
        if not partial and (first := self.failures().where(F.col("tap") == name).orderBy("failed_at").first()):
            raise ValueError(f"tap {name} failed at {first['failed_at']}: {first['reason']}")
        return self._table().where((F.col("tap") == name) & F.col("reason").isNull()).select(f"`{name}`.*")

    def block_map(self) -> DataFrame:
        return self.rows("map")

    def frames(self) -> DataFrame:
        return carve.unnested(self.rows("frames"))

    def packs(self) -> DataFrame:
        return carve.unnested(self.rows("packs"))

    def units(self) -> DataFrame:
        return self.rows("units")


class OtherImage(ValueError):
    """What is there now is not what was scanned."""


def _told(spark: SparkSession, path: str, block: int, numbers: list[int]) -> dict[int, str]:
    """Hashes of a few blocks as they are now."""
    rows = scan_rows(spark, path, [BlockFacts(block)], block, 1, spark.createDataFrame([(n,) for n in numbers], "id long").coalesce(1))
    return {r["index"]: r["sha256"] for r in rows.select("map.index", "map.sha256").collect()}


def verify_same(spark: SparkSession, path: str, scan: Scan, block: int) -> int:
    """Hash the first block and the last two scanned ones again; the number of blocks that were compared.

    Another size, or another hash of one of them, is another image (or a device that has changed): an error, before
    anything is added. Blocks that could not be read in full then are compared as they read now, zeros included.
    """
    from .facts import open_image

    done = scan.block_map()
    ends = done.agg(F.max("index").alias("top"), F.max(F.col("offset") + F.col("length")).alias("end"), F.max("length").alias("length")).first()
    if ends["top"] is None:
        return 0
    size = open_image(path).size
    if ends["end"] > size or (ends["end"] < size and ends["end"] % block):
        raise OtherImage(f"{path} has {size} bytes; the scan's last block ended at {ends['end']}")
    if ends["length"] > block:
        raise OtherImage(f"the scan's blocks have {ends['length']} bytes, not {block}")
    last = [r["index"] for r in done.orderBy(F.desc("index")).select("index").limit(2).collect()]
    known = {r["index"]: r["sha256"] for r in done.where(F.col("index").isin(0, *last)).select("index", "sha256").collect()}
    now = _told(spark, path, block, sorted(known))
    if changed := sorted(n for n in known if known[n] != now.get(n)):
        raise OtherImage(f"{path}: block {changed[0]} is not what was scanned")
    return len(known)


def resumed_scan(spark: SparkSession, path: str, folder: str, taps: list[Tap] | None = None, block: int = 8 << 20, per_task: int = 8, part: int = 4096, most_parts: int | None = None) -> Scan:
    """A scan in parts of ``part`` blocks, each committed with its rows; what an earlier run committed is not read again.

    The block map is the manifest: it is anti-joined from all numbers, after the first and last scanned blocks have been
    hashed again (``verify_same``). ``most_parts`` ends the run early. Rows that look past a block's end are found with
    that block, so parts need nothing of one another.
    """
    from .facts import open_image

    taps = all_taps(block) if taps is None else taps
    if "map" not in {t.name for t in taps}:
        raise ValueError("a scan that can be resumed needs the block map")
    scan = Scan(spark, folder, taps)
    blocks = -(-open_image(path).size // block)
    path_ = spark._jvm.org.apache.hadoop.fs.Path(folder)
    started = path_.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_)
    left = spark.range(0, blocks, 1, max(1, -(-blocks // part)))
    if started:
        verify_same(spark, path, scan, block)
        left = left.join(scan.block_map().select(F.col("index").alias("id")).distinct(), "id", "left_anti")
    todo = store.once(left.groupBy(F.floor(F.col("id") / part).alias("part")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")))
    for row in todo.orderBy("part").toLocalIterator():
        if most_parts is not None and most_parts <= 0:
            break
        numbers = spark.range(row["first"], row["last"] + 1, 1, max(1, -(-row["n"] // per_task)))
        if row["n"] < row["last"] + 1 - row["first"]:
            numbers = numbers.join(store.once(left.where(F.floor(F.col("id") / part) == row["part"])), "id", "left_semi")
        scan_rows(spark, path, taps, block, per_task, numbers).write.mode("append").partitionBy("tap").parquet(folder)
        most_parts = None if most_parts is None else most_parts - 1
    return scan


def shared_scan(spark: SparkSession, path: str, taps: list[Tap] | None = None, block: int = 8 << 20, per_task: int = 8, folder: str | None = None) -> Scan:
    """Read the image once for all ``taps`` (by default all of them) and write their rows to ``folder``, else to the shared one."""
    taps = all_taps(block) if taps is None else taps
    if len({t.name for t in taps}) < len(taps):
        raise ValueError("taps of one scan need names of their own")
    folder = folder or os.path.join(store.shared_dir(spark), f"scan-{uuid.uuid4().hex}")
    scan_rows(spark, path, taps, block, per_task).write.partitionBy("tap").parquet(folder)
    return Scan(spark, folder, taps)
