"""Scans in parts that go on where they ended, and frames across the borders of clusters."""

import hashlib
from datetime import datetime, timedelta

import images
import oracle
import pytest
from blockwright.operators import carve, integrity
from blockwright.sources import facts, taps
from pyspark.sql import functions as F


def root(rows):
    return integrity.merkle_root(rows.select(F.col("index").alias("i"), F.col("sha256").alias("h"))).first()[0]


def test_a_scan_goes_on_where_it_ended(spark, tmp_path):
    disk = images.camera_disk(3, 120)[0]
    path, folder = tmp_path / "disk.img", str(tmp_path / "scan")
    path.write_bytes(disk)
    scan = taps.resumed_scan(spark, str(path), folder, block=4096, per_task=3, part=8, most_parts=2)
    assert scan.block_map().count() == 16
    before = {r[0] for r in scan.block_map().select(F.input_file_name()).distinct().collect()}
    scan = taps.resumed_scan(spark, str(path), folder, block=4096, per_task=3, part=8)
    whole = facts.block_map(spark, str(path), 4096)
    assert root(scan.block_map()) == root(whole) and scan.block_map().count() == whole.count()
    assert oracle.rows(scan.frames().toPandas()) == oracle.rows(facts.frames(spark, str(path), 4096).toPandas())
    after = {r[0] for r in scan.block_map().select(F.input_file_name()).distinct().collect()}
    assert before < after  # what was there was not written again
    taps.resumed_scan(spark, str(path), folder, block=4096, part=8)
    assert {r[0] for r in scan.block_map().select(F.input_file_name()).distinct().collect()} == after


def test_another_image_is_refused(spark, tmp_path):
    disk = bytearray(images.camera_disk(3, 120)[0])
    path, folder = tmp_path / "disk.img", str(tmp_path / "scan")
    path.write_bytes(disk)
    taps.resumed_scan(spark, str(path), folder, block=4096, part=8, most_parts=2)
    for at in (0, 4096 * 15 + 9, 4096 * 14 + 1):  # the first block, and the last two
        other = bytearray(disk)
        other[at] ^= 1
        path.write_bytes(other)
        with pytest.raises(taps.OtherImage):
            taps.resumed_scan(spark, str(path), folder, block=4096, part=8)
    path.write_bytes(disk[: 4096 * 15])
    with pytest.raises(taps.OtherImage):
        taps.resumed_scan(spark, str(path), folder, block=4096, part=8)
    path.write_bytes(disk)
    with pytest.raises(taps.OtherImage):
        taps.resumed_scan(spark, str(path), folder, block=2048, part=8)
    with pytest.raises(ValueError):
        taps.resumed_scan(spark, str(path), folder, [taps.Frames()], block=4096)


def cut_disk(size=4096):
    """A camera whose chain is clusters 0, 2, 5; another's 1, 3. A frame of the first is cut at the end of 0 and finished at the start of 2, and one of 2 runs over into 3."""
    t = datetime(2024, 6, 1, 9)
    make = lambda n, body: images.frame(0xFC, n, t + timedelta(seconds=n), 1000 * n, body)
    clusters = [bytearray() for _ in range(6)]
    n = 0
    while len(clusters[0]) + 500 < size:
        clusters[0] += make(n, bytes([n + 1]) * 300)
        n += 1
    whole = make(n, bytes([n + 1]) * 900)
    cut = size - len(clusters[0])
    clusters[0] += whole[:cut]
    clusters[2] += whole[cut:]
    first = n
    n += 1
    while len(clusters[2]) + 400 < size:
        clusters[2] += make(n, bytes([n + 1]) * 300)
        n += 1
    over = make(n, bytes([n + 1]) * 600)
    rest = size - len(clusters[2])
    clusters[2] += over[:rest]
    tail = images.frame(0xF0, 5, t + timedelta(seconds=n), 1000 * n + 100, b"a" * 40)
    clusters[3] += over[rest:] + tail
    other = datetime(2024, 6, 3)
    for c in (1, 3):
        k = 700 + 50 * c
        while len(clusters[c]) + 400 < size:
            clusters[c] += images.frame(0xFC, k, other + timedelta(seconds=k), 1000 * k, bytes(300))
            k += 1
    return b"".join(bytes(c).ljust(size, b"\0") for c in clusters), whole, first, n, t, other


def test_frames_across_borders(spark):
    size = 4096
    disk, whole, first, last, t, other = cut_disk(size)
    rows = [(0, f[0], *f[1:]) for f in carve.frames_in(disk, 0, len(disk))]
    base = int((t - datetime(1970, 1, 1)).total_seconds())
    spans = [(0, 0, base, base + 300), (0, 2, base, base + 300)] + [(0, c, int((other - datetime(1970, 1, 1)).total_seconds()), int((other - datetime(1970, 1, 1)).total_seconds()) + 2000) for c in (1, 3)]
    found = spark.createDataFrame(rows, carve.FRAME_SCHEMA)
    classified = carve.classified_frames(found, spark.createDataFrame(spans, "volume long, cluster long, start_s long, end_s long"), size)
    links = spark.createDataFrame([(0, 0, 2), (0, 2, 5), (0, 1, 3), (0, 3, 0)], "volume long, cluster long, next long")
    clusters = spark.createDataFrame([(0, c, bytearray(disk[c * size : (c + 1) * size])) for c in range(6)], "volume long, cluster long, content binary")
    (joined,) = carve.rejoined_frames(clusters, links, classified, size).collect()
    assert (joined["cluster"], joined["next"], joined["frame_number"], joined["length"]) == (0, 2, first, len(whole))
    assert joined["sha256"] == hashlib.sha256(whole).hexdigest() and bytes(joined["content"]) == whole
    broken = bytearray(disk)
    broken[2 * size + 40 : 2 * size + 44] = b"DHAV"  # another write over the second part
    clusters = spark.createDataFrame([(0, c, bytearray(broken[c * size : (c + 1) * size])) for c in range(6)], "volume long, cluster long, content binary")
    assert carve.rejoined_frames(clusters, links, classified, size).isEmpty()
    placed = carve.with_overflow(classified, links, size)
    over = placed.where("class = 'overflow'").select("cluster", "home", "ftype", "frame_number").collect()
    assert [tuple(r) for r in over] == [(3, 2, 0xF0, 5)] and placed.count() == classified.count()
    onward = spark.createDataFrame([(0, 2, 3)], "volume long, cluster long, next long")
    assert carve.with_overflow(classified, onward, size).where("class = 'overflow'").isEmpty()
