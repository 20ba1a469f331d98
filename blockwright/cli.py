"""Command line: ``python -m blockwright COMMAND ...``. Tables are written as Parquet, short findings are printed as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("blockwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _out(df: DataFrame, a) -> None:
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        for row in df.limit(a.show).toJSON().toLocalIterator():
            print(row)


def scan(spark, a) -> DataFrame:
    """Block map of an image."""
    from .sources import facts

    return facts.block_map(spark, a.image, a.block)


def hashes(spark, a) -> DataFrame:
    """Whole-image hashes, in order."""
    from .sources import facts

    return facts.whole_hashes(spark, a.image)


def parse(spark, a) -> DataFrame:
    """Recordings that the recorder's own indexes name."""
    from .sources import recorders

    recorders.register(spark)
    return spark.read.format("recorderindex").option("path", a.image).load()


def partitions(spark, a) -> DataFrame:
    """Partitions of an image."""
    from .sources import images

    images.register(spark)
    fmt = "ewfblocks" if a.image[-3:-2].lower() == "e" else "rawblocks"
    return images.partitions(spark.read.format(fmt).option("path", a.image).option("blockSize", 1 << 20).option("end", 1 << 20).load())


def ewf_info(spark, a) -> DataFrame:
    """Size and stored hashes of an E01 set, checked against its media."""
    from .sources import images

    image = images.EwfImage(a.image)
    return spark.createDataFrame([(image.size, len(image.paths), len(image.chunks), image.md5, image.sha1, *image.verify().values())], "bytes long, segments int, chunks long, md5 string, sha1 string, md5_ok boolean, sha1_ok boolean")


def carve(spark, a) -> DataFrame:
    """Camera streams found by their frames alone."""
    from .operators import carve as c
    from .sources import facts

    return c.carve_streams(facts.frames(spark, a.image, a.block))


def carve_ps(spark, a) -> DataFrame:
    """Program streams found by their packs alone."""
    from .operators import carve as c
    from .sources import facts

    return c.pack_streams(facts.packs(spark, a.image, a.block))


def _blocks(spark, a, ahead: int) -> DataFrame:
    from .sources import images

    images.register(spark)
    return spark.read.format("rawblocks").option("path", a.image).option("blockSize", a.block).option("lookAhead", ahead).load()


def carve_annexb(spark, a) -> DataFrame:
    """Raw H.264 and H.265 streams found by their parameter sets."""
    from .operators import carve as c

    return c.elementary_streams(c.nal_units(_blocks(spark, a, 8192)))


def log(spark, a) -> DataFrame:
    """Records of a recorder's system log."""
    from .operators import carve as c

    return c.log_records(_blocks(spark, a, 4096))


def index(spark, a) -> DataFrame:
    """Leaves of the recorder's index tree, de-duplicated, on their common grid."""
    from .operators import carve as c
    from .sources import images

    return c.index_leaves(_blocks(spark, a, 64), images.RawImage(a.image).size)


def extract(spark, a) -> DataFrame:
    """Carved streams written as files, each hashed."""
    from .sources import facts

    return facts.write_clips(carve(spark, a).where("kept"), a.image, a.clips, "sid", "extents", ".dav")


def regions(spark, a) -> DataFrame:
    """Classes of a block map's blocks, in runs."""
    from .operators import detect

    b = spark.read.parquet(a.map).where("not bad")
    kind = detect.region_class(F.col("start_codes"), F.col("length").cast("double"), F.col("incompressibility"), F.lit(0))
    return detect.class_runs(b.withColumn("kind", kind).withColumn("length", F.col("length").cast("bigint")), "offset", "length", "kind", 1 << 33)


def diff(spark, a) -> DataFrame:
    """Blocks that two block maps differ in."""
    from .operators import detect

    return detect.blockmap_diff(spark.read.parquet(a.map), spark.read.parquet(a.other), "offset", "sha256")


def prove(spark, a) -> DataFrame:
    """Merkle root of a block map and the proof of one block."""
    from .operators import integrity

    leaves = spark.read.parquet(a.map).select(F.col("index").alias("i"), F.col("sha256").alias("h"))
    proof = integrity.merkle_proof(leaves, leaves.where(F.col("i") == a.block_index))
    return proof.crossJoin(F.broadcast(integrity.merkle_root(leaves)))


def timeline(spark, a) -> DataFrame:
    """Gaps of each camera in a table of recordings (camera, start_s, end_s)."""
    from .operators import intervals

    rec = spark.read.parquet(a.recordings).where("start_s is not null and end_s is not null").select("camera", "start_s", "end_s", F.monotonically_increasing_id().alias("tie"))
    return intervals.gaps(rec, "camera", "start_s", "end_s", "tie", a.gap)


def query(spark, a) -> DataFrame:
    """A registered query over a folder of tables."""
    from . import registry

    return registry.queries()[a.name](spark, a.folder)


def ledger(_, a) -> None:
    """Append to a custody ledger, or verify it."""
    from .sources.facts import Ledger

    book = Ledger(a.file)
    if a.action:
        print(json.dumps(book.append(a.action, json.loads(a.detail), a.actor, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))))
    broken = book.first_break()
    print(json.dumps({"entries": len(book.entries()), "first_break": broken and broken[0], "reason": broken and broken[1]}))


def _blocks(spark, a, before: int = 0, after: int = 0) -> DataFrame:
    from .sources import images

    images.register(spark)
    fmt = "ewfblocks" if a.image[-3:-2].lower() == "e" else "rawblocks"
    return spark.read.format(fmt).option("path", a.image).option("blockSize", a.block).option("lookBehind", before).option("lookAhead", after).load()


def scan_all(spark, a) -> DataFrame:
    """One read of an image for the block map, frames, packs and start codes, into a folder; a scan that was ended goes on."""
    from .sources import taps

    done = taps.resumed_scan(spark, a.image, a.folder, block=a.block)
    return spark.createDataFrame([(name, done.rows(name, partial=True).count()) for name in done.taps], "tap string, rows long").join(done.failures().groupBy("tap").agg(F.count("*").alias("failed_tasks")), "tap", "left")


def survey(spark, a) -> DataFrame:
    """Length and date fields behind tokens (parted by commas) in an image of unknown format."""
    from .operators import survey as s

    return s.token_fields(s.token_geometry(_blocks(spark, a).select(F.col("content").alias("data")), [t.encode() for t in a.tokens.split(",") if t]))


def identify(spark, a) -> DataFrame:
    """Where an image holds identifiers, given as kind=value parted by commas (serial, device or mac), in each form that they are written in."""
    from .operators import identify as i

    pairs = [tuple(x.split("=", 1)) for x in a.identifiers.split(",") if "=" in x]
    wanted = i.forms([("mac" if kind == "mac" else "text", value) for kind, value in pairs])
    longest = max((len(w[2]) for w in wanted), default=1)
    return i.identifier_report(spark, i.identifier_hits(_blocks(spark, a, 1, longest + 1), wanted), wanted)


def seal(spark, a) -> DataFrame:
    """Blocks of an image, encrypted under the 32 bytes of a key file and bound to a package's name and their places."""
    from .operators import sealing

    with open(a.key, "rb") as f:
        return sealing.sealed(_blocks(spark, a).select(F.floor(F.col("offset") / a.block).alias("index"), "content"), f.read(), a.package)


def unseal(spark, a) -> DataFrame:
    """Blocks of a sealed package again; those that were changed or moved are not ok."""
    from .operators import sealing

    with open(a.key, "rb") as f:
        return sealing.unsealed(spark.read.parquet(a.sealed), f.read(), a.package)


def seal_check(spark, a) -> DataFrame:
    """The root of a sealed package, and the breaks that show without its key."""
    from .operators import sealing

    rows = spark.read.parquet(a.sealed)
    return sealing.seal_root(rows).join(sealing.seal_breaks(rows), F.lit(True), "left")


def preserve(spark, a) -> DataFrame:
    """Blocks of a map that regions (name, start, end) touch, each once, with the regions' names."""
    from .sources import facts

    return facts.preserved(spark.read.parquet(a.map), spark.read.parquet(a.regions))


def chains(spark, a) -> DataFrame:
    """Files of an index table (volume, idx, kind, next, prev, seq), with what is wrong with their chains."""
    from .operators import chains as c

    return c.chain_files(spark.read.parquet(a.slots))


def calibrate(spark, a) -> DataFrame:
    """Where slot 0 of each volume lies, from its index slots and the frames that stand at cluster starts."""
    from .operators import chains as c

    return c.data_base(spark.read.parquet(a.slots), spark.read.parquet(a.marks), a.block)


def read_clocks(spark, a) -> DataFrame:
    """Painted clocks of a table of readings (column raw): all times that they allow, half of the day and weekday."""
    from .operators import titles

    rows = spark.read.parquet(a.readings)
    return rows.select("*", titles.clock_readings(F.col("raw")).alias("clock"))


def read_titles(spark, a) -> DataFrame:
    """Painted titles of a table of readings (column raw), and the form that they are compared in."""
    from .operators import titles

    title = titles.normal_title(F.col("raw"))
    return spark.read.parquet(a.readings).select("*", title.alias("title"), titles.canonical(title).alias("form"))


#: Commands with their own arguments.
COMMANDS = {
    "scan": (scan, ["image"]), "hashes": (hashes, ["image"]), "partitions": (partitions, ["image"]), "ewf-info": (ewf_info, ["image"]), "parse": (parse, ["image"]), "carve": (carve, ["image"]),
    "carve-ps": (carve_ps, ["image"]), "carve-annexb": (carve_annexb, ["image"]), "log": (log, ["image"]), "index": (index, ["image"]), "extract": (extract, ["image", "clips"]), "regions": (regions, ["map"]),
    "diff": (diff, ["map", "other"]), "prove": (prove, ["map", "block_index"]), "timeline": (timeline, ["recordings"]), "query": (query, ["name", "folder"]), "ledger": (ledger, ["file"]),
    "scan-all": (scan_all, ["image", "folder"]), "survey": (survey, ["image", "tokens"]), "identify": (identify, ["image", "identifiers"]), "seal": (seal, ["image", "key", "package"]), "unseal": (unseal, ["sealed", "key", "package"]),
    "seal-check": (seal_check, ["sealed"]), "preserve": (preserve, ["map", "regions"]), "chains": (chains, ["slots"]), "calibrate": (calibrate, ["slots", "marks"]), "read-clocks": (read_clocks, ["readings"]), "read-titles": (read_titles, ["readings"]),
}


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="blockwright", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (run, own) in COMMANDS.items():
        p = sub.add_parser(name, help=run.__doc__)
        for x in own:
            p.add_argument(x, type=int if x == "block_index" else str)
        p.add_argument("--out", help="folder for the result as Parquet; without it rows are printed")
        p.add_argument("--show", type=int, default=50, help="rows to print")
        p.add_argument("--block", type=int, default=8 << 20, help="bytes of a block")
        p.add_argument("--gap", type=int, default=60, help="seconds that make a gap")
        if name == "ledger":
            p.add_argument("--action"), p.add_argument("--detail", default="{}"), p.add_argument("--actor", default="")
    a = top.parse_args(args)
    run = COMMANDS[a.command][0]
    if a.command == "ledger":
        run(None, a)
    else:
        _out(run(_session(), a), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
