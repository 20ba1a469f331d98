"""Answers of the queries that no SQL covers, against plain Python over the same rows; and rules on rows written by hand."""

import math
import random
import statistics
import struct
import zlib

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from blockwright.functions import columns, kernels
from blockwright.operators import carve, daylight, leads, match
from blockwright.plans import case
from blockwright.plans import leads as lead_plans
from blockwright.plans import match as match_plans

US = columns.US


def over(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def box_of(r):
    return tuple(r[f"x{k}"] for k in (1, 2, 3, 4))


def test_merged_boxes(spark):
    groups = {}
    for r in lead_plans._boxes(spark, oracle.DATA).collect():
        groups.setdefault((r["clip"], r["t"] // 10), []).append(r)
    want = set()
    for rows in groups.values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r["score"], r["id"])):
            if all(over(box_of(r), box_of(k)) < 0.5 for k in kept):
                kept.append(r)
        want |= {r["id"] for r in kept}
    assert {r["id"] for r in lead_plans.merged_boxes(spark, oracle.DATA).collect()} == want


def parked(rows):
    spots = []
    for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
        if not r["static"] or r["label"] not in ("car", "bus", "truck"):
            continue
        s = next((s for s in spots if over(s["box"], box_of(r)) >= 0.5), None)
        if s is None:
            spots.append(s := {"box": box_of(r), "score": r["score"], "labels": [], "t": set()})
        if r["score"] > s["score"]:
            s["box"], s["score"] = box_of(r), r["score"]
        s["labels"].append(r["label"]), s["t"].add(r["t"])
    return [(k, max(dict.fromkeys(s["labels"]), key=s["labels"].count), len(s["t"]), min(s["t"]), max(s["t"]), s["score"]) for k, s in enumerate(spots)]


def test_parked_spots(spark):
    clips = {}
    for r in lead_plans.vehicles(spark, oracle.DATA).collect():
        clips.setdefault(r["clip"], []).append(r)
    want = {(c, *s) for c, rows in clips.items() for s in parked(rows)}
    got = {(r["clip"], r["spot"], r["label"], r["frames"], r["first"], r["last"], r["score"]) for r in lead_plans.parked_spots(spark, oracle.DATA).collect()}
    assert got == want and any(s[2] == "car" for s in want)


def test_parked_labels_and_frames(spark):
    at = [0.0, 0.0, 0.4, 0.4]
    rows = [(1, 0, 0, "bus", 0.5, *at, True), (1, 0, 1, "car", 0.9, *at, True), (1, 1, 2, "car", 0.4, *at, True), (1, 2, 3, "person", 1.0, *at, True), (1, 3, 4, "truck", 1.0, 0.5, 0.5, 0.9, 0.9, False)]
    df = spark.createDataFrame(rows, "clip long, t long, id long, label string, score double, x1 double, x2 double, x3 double, x4 double, static boolean")
    assert [tuple(r) for r in leads.parked_spots(df).collect()] == [(1, 0, "car", 2, 0, 1, 0.9)]


def test_true_boxes_by_cells_equal_all_pairs(spark):
    rng = random.Random(4)
    make = lambda n: [(k % 2, k, x := rng.uniform(-1, 1), y := rng.uniform(-1, 1), x + rng.uniform(0, 0.9), y + rng.uniform(0, 0.9)) for k in range(n)]
    boxes, truth = make(60), make(40)
    a = spark.createDataFrame(boxes, "clip long, id long, x1 double, x2 double, x3 double, x4 double")
    b = spark.createDataFrame(truth, "clip long, tid long, y1 double, y2 double, y3 double, y4 double")
    got = sorted((r["id"], r["tid"]) for r in leads.truth_pairs(a, b, 0.1).collect())
    assert got == sorted((x[1], y[1]) for x in boxes for y in truth if x[0] == y[0] and over(x[2:], y[2:]) >= 0.1)


def test_nearest_faces_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)] + [[1.0] * 8] * 3
    faces = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>").repartition(5)
    wanted = faces.where("id % 7 = 0").select(F.col("id").alias("w"), F.col("v").alias("wv"))
    want = {}
    f32 = [[struct.unpack("f", struct.pack("f", x))[0] for x in v] for v in vectors]
    for w in range(0, len(vectors), 7):
        dots = sorted((-sum(a * b for a, b in zip(f32[w], f32[k])), k) for k in range(len(vectors)) if k != w)
        want |= {(w, k, n): -s for n, (s, k) in enumerate(dots[:9], 1)}
    for block in (4096, 3):
        monkeypatch.setattr(leads, "WANTED", block)
        got = {(r["w"], r["id"], r["rank"]): r["similarity"] for r in leads.nearest_faces(faces, wanted, 9, "id", "v", "w", "wv").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        counts = {r["w"]: (r["compared"], r["candidates"]) for r in leads.candidate_counts(faces, wanted, "id", "v", "w", "wv").collect()}
        assert counts == {w: (len(vectors) - 1, sum(k != w and sum(a * b for a, b in zip(f32[w], f32[k])) >= leads.MATCH for k in range(len(vectors)))) for w in range(0, len(vectors), 7)}
    assert leads.nearest_faces(faces, wanted.limit(0), 9, "id", "v", "w", "wv").count() == 0


def test_longest_chains(spark):
    rng = random.Random(6)
    rows = [(s, p, rng.randrange(40)) for s in range(5) for p in range(30)]
    got = {r["source"]: (r["anchors"], r["chain"]) for r in match.longest_chains(spark.createDataFrame(rows, "s long, p long, o long").repartition(3), "s", "p", "o").collect()}
    for s in range(5):
        best = [0] * 30
        own = [o for a, _, o in rows if a == s]
        for k in range(30):
            best[k] = 1 + max((best[j] for j in range(k) if own[j] < own[k]), default=0)
        assert got[s] == (30, max(best))
    assert match_plans.QUERIES["o11_longest_chains"](spark, oracle.DATA).where("chain > anchors or chain < 1").count() == 0


def test_python_kernels(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect()}
    for r in case.python_kernels(spark, oracle.DATA).collect():
        b = texts[r["doc_id"]]
        head = b[:4096]
        assert r["incompressibility"] == (round(min(1.0, len(zlib.compress(head, 1)) / len(head)), 4) if head else 0.0)
        assert r["adler32"] == zlib.adler32(b) and r["start_codes"] == b.count(b"\0\0\1") and r["container"] == "unknown"
        kind = "zero" if not b.strip(b"\0") else "fill" if len(set(b)) == 1 else "dense" if r["incompressibility"] >= 0.95 else "structured"
        assert r["kind"] == kind
        assert (r["sps"], r["pps"], r["idr"], r["hevc_ps"]) == kernels.census(b) == (0, 0, 0, 0)  # texts have no start codes
        if len(b) < 3000:
            crc = 0
            for byte in b:  # bit by bit
                crc ^= byte
                for _ in range(8):
                    crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
            assert r["crc16"] == crc


def test_containers():
    frame = bytearray(b"DHAV" + bytes(19))
    frame.append(sum(frame) & 0xFF)
    for head, want in (
        (b"IMKH....", "ps"), (b"\0\0\1\xba..", "ps"), (b"1234ftyp", "mp4"), (b"RIFF1234AVI ", "avi"), (b"RIFF1234WAVE", "unknown"), (kernels.ASF + b"..", "asf"), (b"\0\0\1\x67", "annexb"), (b"\0\0\0\1\x67", "annexb"),
        (b"junk DHAV" + bytes(40) + bytes(frame), "dhav"), (b"DHAV" + bytes(19) + b"\1", "unknown"), (b"junk\0\0\1\xba", "ps"), (b"", "unknown"),
    ):
        assert kernels.container(head) == want, head


def sps(profile=66, level=30, sid=0, order=2, frames=1, wide=39, high=29):
    bits = []
    put = lambda v, n: bits.extend(v >> (n - 1 - k) & 1 for k in range(n))

    def ue(v):
        n = (v + 1).bit_length()
        put(0, n - 1), put(v + 1, n)

    put(profile, 8), put(0, 8), put(level, 8), ue(sid), ue(0), ue(order)
    ue(frames), put(0, 1), ue(wide), ue(high), put(1, 1), put(1, 1), put(0, 1), put(0, 1), put(1, 1)
    return b"\x67" + kernels.escape(bytes(int("".join(map(str, (bits + [0] * 8)[k : k + 8])), 2) for k in range(0, len(bits), 8)))


def test_parameter_sets_hold_to_the_standard():
    assert kernels.h264_picture(sps())[:4] == (640, 480, 66, 30)
    for bad in (sps(profile=67), sps(level=14), sps(sid=32), sps(order=3), sps(frames=17), sps(wide=2), sps(high=600)):
        assert kernels.h264_picture(bad) is None
    assert kernels.h264_picture(sps() + b"\xaa\xbb")[4] == kernels.h264_picture(sps())[4] != kernels.h264_picture(sps(wide=40))[4]


def test_signatures_with_one_pattern(spark):
    df = spark.createDataFrame([(0, b"..MAGIC..MAG", None), (12, b"IC....", b"..MAGIC..MAG")], "offset long, content binary, before binary")
    got = sorted(map(tuple, carve.signature_hits(df, {"a": b"MAGIC", "b": b"MAGIC", "c": b"MAG"}).collect()))
    assert got == [("a", 2), ("a", 9), ("b", 2), ("b", 9), ("c", 9)] or got == [("a", 2), ("a", 9), ("b", 2), ("b", 9)]


def switches_by_hand(readings, least, gap):
    kept = []
    for t, ir in sorted(readings):
        if kept and kept[-1][0] == ir:
            kept[-1][1].append(t)
        else:
            kept.append([ir, [t]])
    runs, kept = kept, []
    for ir, ts in runs:
        if kept and (len(ts) < least or kept[-1][0] == ir):
            kept[-1][1] += ts
        else:
            kept.append([ir, list(ts)])
    out = []
    for (_, a), (ir, b) in zip(kept, kept[1:]):
        if min(len(a), len(b)) >= least and b[0] - a[-1] <= gap:
            out.append(("dusk" if ir else "dawn", a[-1] + (b[0] - a[-1]) // 2, (b[0] - a[-1]) // 2))
    return out


def test_short_runs_belong_to_what_stood_before(spark):
    rng = random.Random(7)
    cases = ["CCCIIICCC", "CCCIICCCIII", "ICCCIII", "ICICCCCII", "CCIII", "CCCIIIICIIICCC", *("".join(rng.choice("CI") for _ in range(40)) for _ in range(8)), "".join(rng.choice("CCCCIIII") * 3 for _ in range(20))]
    rows = [(c, 10 * k * (1 + (k > 30)), k, x == "I") for c, s in enumerate(cases) for k, x in enumerate(s)]
    df = spark.createDataFrame(rows, "lane long, t long, id long, ir boolean").repartition(4)
    for stretch in (25, 10_000):
        got = daylight.light_switches(df, "lane", "t", ["id"], F.col("ir"), gap=100, stretch=stretch).collect()
        for c in range(len(cases)):
            assert sorted(tuple(r)[1:] for r in got if r["lane"] == c) == sorted(switches_by_hand([(t, ir) for lane, t, _, ir in rows if lane == c], 3, 100)), cases[c]


def sun(utc_s, lat, lon):
    """Height of the sun by the declination and hour angle of the general solar equations."""
    century = (utc_s / 86400 + 2440587.5 - 2451545.0) / 36525
    rad, deg = math.radians, math.degrees
    long0 = (280.46646 + century * (36000.76983 + century * 0.0003032)) % 360
    m = rad(357.52911 + century * (35999.05029 - 0.0001537 * century))
    e = 0.016708634 - century * (0.000042037 + 0.0000001267 * century)
    node = rad(125.04 - 1934.136 * century)
    true = long0 + math.sin(m) * (1.914602 - century * (0.004817 + 0.000014 * century)) + math.sin(2 * m) * (0.019993 - 0.000101 * century) + math.sin(3 * m) * 0.000289
    tilt = rad(23 + (26 + (21.448 - century * (46.815 + century * (0.00059 - century * 0.001813))) / 60) / 60 + 0.00256 * math.cos(node))
    decl = math.asin(math.sin(tilt) * math.sin(rad(true - 0.00569 - 0.00478 * math.sin(node))))
    y, two = math.tan(tilt / 2) ** 2, 2 * rad(long0)
    equation = 4 * deg(y * math.sin(two) - 2 * e * math.sin(m) + 4 * e * y * math.sin(m) * math.cos(two) - y * y / 2 * math.sin(2 * two) - 1.25 * e * e * math.sin(2 * m))
    angle = rad((utc_s / 60 % 1440 + equation + 4 * lon) % 1440 / 4 - 180)
    return deg(math.asin(math.sin(rad(lat)) * math.sin(decl) + math.cos(rad(lat)) * math.cos(decl) * math.cos(angle)))


def test_clock_from_daylight_equals_a_full_search(spark):
    day, lat, lon = 86_400, 13.08, 80.27
    base = 19_700 * day
    events = [("a", "dawn", base + k * day + 6 * 3600 + 60 * (k % 3)) for k in range(4)] + [("a", "dusk", base + k * day + 18 * 3600 + 600 + 60 * (k % 2)) for k in range(4)]
    df = spark.createDataFrame([(c, k, t * US) for c, k, t in [*events, ("b", "dusk", base)]], "lane string, kind string, at_us long")
    got = {r["lane"]: r for r in daylight.clock_offset(df, "lane", lat, lon).collect()}
    assert got["b"]["offset_min"] is None and got["b"]["events"] == 1
    best = None
    for t in range(-840, 841):
        hs = [sun(s - 60 * t, lat, lon) for _, _, s in events]
        rising = [sun(s - 60 * t + 120, lat, lon) > h for (_, _, s), h in zip(events, hs)]
        if all(r == (k == "dawn") for r, (_, k, _) in zip(rising, events)) and -12 <= statistics.fmean(hs) <= 10 and (best is None or statistics.pstdev(hs) < best[0] - 1e-12):
            best = (statistics.pstdev(hs), t, statistics.fmean(hs))
    r = got["a"]
    assert r["offset_min"] == best[1] and abs(r["elevation"] - best[2]) < 1e-9 and abs(r["spread"] - best[0]) < 1e-9
    own = sorted(min((abs(sun(s - 60 * t, lat, lon) - best[2]), t) for t in range(best[1] - 180, best[1] + 181))[1] for _, _, s in events)
    q = statistics.quantiles(own, n=4)
    assert (r["median"], r["low_quartile"], r["high_quartile"], r["least"], r["most"]) == (statistics.median(own), q[0], q[2], own[0], own[-1])


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_exclusive_quartiles(spark, n):
    rng = random.Random(n)
    values = sorted(rng.randrange(100) for _ in range(n))
    got = spark.range(1).select(*[columns.exclusive_quartile(F.lit(values), k) for k in (1, 2, 3)]).first()
    assert list(got) == statistics.quantiles(values, n=4)


def test_carve_of_one_pass_equals_frames_in_order(spark):
    rows = [tuple(r) for r in case.frame_rows(spark, oracle.DATA).orderBy("volume", "offset").select("volume", "offset", "ftype", "frame_number", "length", "ms", "date").collect()]
    want = {}
    for volume in {r[0] for r in rows}:
        open_, prior, count = [], None, 0
        for _, offset, ftype, number, length, ms, date in (r for r in rows if r[0] == volume):
            kind = "video" if ftype in (0xFD, 0xFC, 0xFB) else "audio"
            seconds = calendar(date)

            def far(s):
                step = (ms - s["ms"] + 0x8000) % 0x10000 - 0x8000
                if not -500 <= step <= 4000 or not -1 <= seconds - s["seconds"] <= 4:
                    return None
                on = number - s["last"].get(kind, number - 1)
                return abs(step) / 40 + abs(on - 1) if -4 <= on <= 128 else None

            open_ = [s for s in open_ if offset - s["at"] <= carve.RETIRE]
            near = sorted((d, k) for k, s in enumerate(open_) if (d := far(s)) is not None)
            target = prior[1] if prior and prior[0] == offset and far(prior[1]) is not None else None
            if target is None and near and (len(near) == 1 or near[1][0] > 4 * max(near[0][0], 1.0)):
                target = open_[near[0][1]]
            if target is None:
                target = want[volume, count] = {"last": {}, "frames": 0, "bytes": 0, "first": offset}
                open_.append(target)
                count += 1
            elif number <= target["last"].get(kind, number - 1):
                continue
            target |= {"ms": ms, "seconds": seconds, "at": offset}
            target["last"][kind] = number
            target["frames"] += 1
            target["bytes"] += length
            prior = (offset + length, target)
    got = {(r["volume"], r["sid"]): (r["first_offset"], r["frames"], r["bytes"]) for r in case.carved_streams(spark, oracle.DATA).collect()}
    assert got == {k: (s["first"], s["frames"], s["bytes"]) for k, s in want.items()}


def calendar(date):
    from datetime import datetime, timezone

    return int(datetime((date >> 26) + 2000, date >> 22 & 15, date >> 17 & 31, date >> 12 & 31, date >> 6 & 63, date & 63, tzinfo=timezone.utc).timestamp())


def test_faces_meet_wanted_ones_in_bounded_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([[float(k), 1.0] for k in range(10_000)])], ["f", "v"])
    parts = list(leads._vectors(iter([batch]), leads.WANTED))
    assert max(len(own) for own, _ in parts) * leads.WANTED <= leads.PRODUCTS
    assert [k for own, _ in parts for k in own] == list(range(10_000)) and all((x[:, 0] == own).all() for own, x in parts)
    j, f, s = leads._best(2, np.array([1, 0, 1, 1, 0]), np.array([5, 9, 4, 3, 8]), np.array([0.5, 0.1, 0.7, 0.5, 0.1]))
    assert (j.tolist(), f.tolist(), s.tolist()) == ([0, 0, 1, 1], [8, 9, 4, 3], [0.1, 0.1, 0.7, 0.5])
