"""Sources and carvers over made images with known contents."""

import struct

import images
from blockwright.functions import kernels
from blockwright.operators import carve, chains
from blockwright.sources import images as source
from pyspark.sql import functions as F


def blocks(spark, tmp_path, data: bytes, block: int = 4096, ahead: int = 1 << 16, fmt: str = "rawblocks"):
    path = tmp_path / ("disk.E01" if fmt == "ewfblocks" else "disk.img")
    path.write_bytes(data)
    source.register(spark)
    return spark.read.format(fmt).option("path", str(path)).option("blockSize", block).option("lookAhead", ahead).option("blocksPerTask", 2).load()


def test_raw_blocks_cover_the_image(spark, tmp_path):
    data = bytes(range(256)) * 100 + b"tail"
    rows = blocks(spark, tmp_path, data, ahead=10).orderBy("offset").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == data
    assert bytes(rows[0]["after"]) == data[4096:4106] and not any(r["bad"] for r in rows)


def test_ewf_reads_and_verifies(spark, tmp_path):
    media = bytes(i * 7 % 251 for i in range(512 * 50))
    rows = blocks(spark, tmp_path, images.e01(media), block=5000, ahead=0, fmt="ewfblocks").orderBy("offset").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == media
    image = source.EwfImage(str(tmp_path / "disk.E01"))
    assert image.verify() == {"md5": True, "sha1": True} and image.read(511, 3) == media[511:514]


def test_segment_names():
    names = source.segment_names("a.E01")
    got = [next(names) for _ in range(101)]
    assert got[0] == "a.E01" and got[98] == "a.E99" and got[99] == "a.EAA" and got[100] == "a.EAB"


def test_partitions(spark, tmp_path):
    assert source.partition_rows(images.partitioned(False)) == [(0, 2048 * 512, 9999 * 512, "mbr", "FAT32-LBA", 0.95)]
    rows = source.partitions(blocks(spark, tmp_path, images.partitioned(True), block=1 << 20)).collect()
    assert [(r["scheme"], r["type_hint"], r["start_offset"], r["length"]) for r in rows] == [("gpt", "ring", 51200, 51200)]
    assert source.partition_rows(b"") == []


def test_frames_do_not_depend_on_blocks(spark, tmp_path):
    disk, truth = images.camera_disk()
    whole = carve.frames_in(disk, 0, len(disk))
    assert len(whole) == sum(truth.values())
    for size in (1000, 4096, len(disk)):
        assert carve.frames(blocks(spark, tmp_path, disk, size)).count() == len(whole)


def test_carve_separates_cameras(spark, tmp_path):
    disk, truth = images.camera_disk()
    rows = carve.carve_streams(carve.frames(blocks(spark, tmp_path, disk))).orderBy("first_offset").collect()
    assert [r["frames"] for r in rows] == list(truth.values()) and all(r["kept"] and r["i_frames"] == 6 for r in rows)
    assert sum(e["length"] for e in rows[0]["extents"]) == rows[0]["bytes"]


def test_repeats_are_dropped():
    disk, _ = images.camera_disk(1, 30)
    frames = [{"offset": f[0], "kind": 0, "key": f[1] == carve.KEY, "frame_number": f[2], "length": f[3], "ms": f[5], "seconds": 700_000_000 + f[2] // 3} for f in carve.frames_in(disk, 0, len(disk))]
    streams = carve.Streams()
    for f in [*frames[:20], frames[18], *frames[20:]]:
        streams.add(f)
    pieces = streams.close()
    assert {p[0] for p in pieces} == {0} and sum(p[3] for p in pieces) == 30 and sum(p[6] for p in pieces) == 1


def test_false_frames_hide_nothing(spark):
    """A frame inside a frame is dropped, and what it covers beyond that one is not; wherever blocks begin."""
    rows = [(0, 0, 100), (0, 50, 100), (0, 100, 60), (0, 120, 10), (0, 160, 5), (1, 0, 10), (1, 9, 2), (1, 10, 3)]
    found = spark.createDataFrame(rows, "volume long, offset long, length long").repartition(3)
    assert sorted(map(tuple, carve.unnested(found).collect())) == [(0, 0, 100), (0, 100, 60), (0, 160, 5), (1, 0, 10), (1, 10, 3)]


def test_clock_wraps(spark, tmp_path):
    data = images.program_stream([((1 << 33) - 3600 * 10, 30), (5_000_000, 24), (9_000_000, 25)])
    got = carve.pack_streams(carve.packs(blocks(spark, tmp_path, data))).orderBy("stream").collect()
    assert [r["packs"] for r in got] == [29, 23, 24] or [r["packs"] for r in got] == [30, 24, 25]
    assert got[0]["kept"] and got[0]["first_scr"] > got[0]["last_scr"]


def test_clock_of():
    for clock in (0, 1, 90_000, (1 << 33) - 1, 0x155555555):
        assert carve.clock_of(images.pack(clock, b"x")[:14]) == clock


def test_index_leaves(spark, tmp_path):
    grid = 1 << 20
    a = images.leaf(3, 1_600_000_000, 1_600_003_600, 4096 + 5 * grid)
    off = images.leaf(4, 1_600_000_000, 1_600_000_001, 77 + grid)
    data = bytes(64) + a + images.leaf(2, 1_600_000_000, 1_600_000_500, 4096 + grid) + bytes(48) + a + off + images.leaf(1, 5, 4, 10)
    rows = carve.index_leaves(blocks(spark, tmp_path, data, 128, 64), 1 << 40, grid).orderBy("channel").collect()
    assert [(r["channel"], r["copies"], r["block"]) for r in rows] == [(2, 1, 1), (3, 2, 5)] and rows[1]["at"] == 64


def test_log_records(spark, tmp_path):
    t = 1_650_000_000
    data = b"xxRATS" + bytes(30) + images.log_record(t, 3, 0x43, b"admin") + images.log_record(t + 60, 3, 0x41) + images.log_record(t + 70, 9, 1) + images.log_record(t + 90, 3, 7)
    rows = carve.log_records(blocks(spark, tmp_path, data, 64, 32)).orderBy("offset").collect()
    assert [r["kind"] for r in rows] == ["abnormal_shutdown", "power_on", "user_action"] and rows[0]["bytes"] == 21 and rows[-1]["bytes"] is None


def test_chains(spark):
    rows = [(0, 1, 1, 2, 0, 2), (0, 2, 2, 3, 1, 1), (0, 3, 2, 0, 2, 2), (0, 5, 1, 6, 0, 1), (0, 6, 2, 5, 5, 1), (0, 8, 1, 9, 0, 1)]
    got = chains.index_chains(spark.createDataFrame(rows, "volume long, idx long, kind int, next long, prev long, seq long")).orderBy("head").collect()
    assert [(r["head"], r["clusters"], r["note"]) for r in got] == [(1, [1, 2, 3], ""), (5, [5, 6], "loop"), (8, [8], "broken link")]


def test_elementary_streams(spark):
    rows = [(0, 0, "h264", "sps", "a")] + [(0, 10 * k, "h264", "key" if k == 1 else "slice", None) for k in range(1, 40)] + [(0, 500, "h264", "sps", "b"), (0, 510, "h264", "slice", None), (0, 10_000_000, "h264", "slice", None)]
    got = carve.elementary_streams(spark.createDataFrame(rows, "volume long, offset long, codec string, kind string, key string")).orderBy("stream").collect()
    assert [(r["sps_key"], r["slices"], r["bytes"], r["kept"]) for r in got] == [("a", 39, 390, True), ("b", 1, 10, False)]


def test_parameter_sets():
    bits = []
    put = lambda v, n: bits.extend(v >> (n - 1 - k) & 1 for k in range(n))

    def ue(v):
        n = (v + 1).bit_length()
        put(0, n - 1), put(v + 1, n)

    put(66, 8), put(0, 8), put(30, 8), ue(0), ue(0), ue(2), ue(1), put(0, 1), ue(39), ue(29), put(1, 1), put(1, 1), put(0, 1), put(0, 1), put(1, 1)
    body = bytes(int("".join(map(str, (bits + [0] * 8)[k : k + 8])), 2) for k in range(0, len(bits), 8))
    assert kernels.h264_picture(b"\x67" + kernels.escape(body))[:4] == (640, 480, 66, 30)
    assert kernels.h264_picture(b"\x67") is None and kernels.h265_picture(b"\x42\x01\xff") is None


def test_kernels(spark):
    assert kernels.unescape(kernels.escape(b"\0\0\0\0\1\0\0\3")) == b"\0\0\0\0\1\0\0\3"
    assert kernels.crc16_arc(b"123456789") == 0xBB3D
    assert kernels.incompressibility(b"") == 0 and kernels.incompressibility(bytes(5000)) < 0.05
    assert kernels.census(b"\0\0\1\x67ab\0\0\1\x68\0\0\1\x65\0\0\1\x40\x01") == (1, 1, 1, 1)
    assert [kernels.sample_kind(x) for x in (bytes(9), b"aaaa")] == ["zero", "fill"]
    assert kernels.container(b"....ftypisom") == "mp4" and kernels.container(b"") == "unknown"
    df = spark.createDataFrame([(bytearray(struct.pack("<IQ", 7, (1 << 64) - 1)),), (None,)], "b binary")
    rows = df.select(kernels.decode_struct({"a": (0, "<I"), "q": (4, "<Q"), "z": (40, "<B")})("b").alias("s")).select("s.*").collect()
    assert rows[0]["a"] == 7 and int(rows[0]["q"]) == (1 << 64) - 1 and rows[0]["z"] is None and rows[1]["a"] is None
    assert df.select(kernels.census_udf("b").alias("c"), kernels.adler32_udf("b").alias("d"), kernels.incompressibility_udf("b").alias("i"), kernels.sample_kind_udf("b").alias("k"), kernels.container_udf("b").alias("m"), kernels.crc16_udf("b").alias("x")).count() == 2


def test_hostile_images_give_rows_not_errors(spark, tmp_path):
    import random

    rng = random.Random(9)
    disk = bytearray(images.camera_disk(1, 20)[0][:20_000])
    for _ in range(200):
        disk[rng.randrange(len(disk))] = rng.choice((0, 255, rng.randrange(256)))
    df = blocks(spark, tmp_path, bytes(disk[:-7]))
    for found in (carve.frames(df), carve.packs(df), carve.index_leaves(df, 1 << 40), carve.log_records(df), carve.nal_units(df)):
        found.select(F.count("*")).collect()


def test_signatures_across_blocks(spark, tmp_path):
    data = bytearray(5000)
    for at in (0, 1020, 1022, 2046, 3000, 4990):
        data[at : at + 5] = b"MAGIC"
    data[3000:3008] = b"MAGMAGIC"
    path = tmp_path / "disk.img"
    path.write_bytes(data)
    source.register(spark)
    df = spark.read.format("rawblocks").option("path", str(path)).option("blockSize", 1024).option("lookBehind", 4).load()
    rows = carve.signature_hits(df, {"a": b"MAGIC", "b": b"MAGM"}).orderBy("offset").collect()
    import re

    assert [(r["signature_id"], r["offset"]) for r in rows] == [("a" if m[0] == b"MAGIC" else "b", m.start()) for m in re.finditer(b"MAGIC|MAGM", bytes(data))]


def test_clusters_remnants_and_files(spark):
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 2, 12)
    rows, n = [], 0
    put = lambda cluster, when, number: rows.append((0, cluster * 1000 + len([r for r in rows if r[1] // 1000 == cluster]) * 20, 0xFD, number, 20, images.packed(when), 0, 0))
    for cluster in (2, 5):
        for k in range(10):
            put(cluster, t + timedelta(seconds=n), n)
            n += 1
    put(5, t + timedelta(seconds=5), 5)
    for k in range(30):
        put(5, t - timedelta(days=3) + timedelta(seconds=k), 900 + k)
    put(5, t - timedelta(seconds=60), 1)
    put(7, t, 3)
    base = int((t - datetime(1970, 1, 1)).total_seconds())
    frames = spark.createDataFrame(rows, carve.FRAME_SCHEMA)
    clusters = spark.createDataFrame([(0, 2, base, base + 30), (0, 5, base, base + 30)], "volume long, cluster long, start_s long, end_s long")
    got = carve.classified_frames(frames, clusters, 1000)
    assert {r["class"]: r["count"] for r in got.groupBy("class").count().collect()} == {"own": 21, "remnant": 30, "spill": 1, "unassigned": 1}
    (old,) = carve.remnants(got).collect()
    assert old["frames"] == 30 and old["last_s"] - old["first_s"] == 29
    (file,) = carve.reassembled(got, spark.createDataFrame([(0, 2, [2, 5])], "volume long, head long, clusters array<long>")).collect()
    assert file["frames"] == 20 and file["missing"] == 0 and file["bytes"] == 400 and file["extents"][0]["offset"] == 2000
