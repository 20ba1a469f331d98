"""Token geometry, identifiers, pictures, sealed blocks and plane geometry against plain Python."""

import os
import random
import re
import struct
from datetime import datetime

import images
import numpy as np
import pytest
from blockwright.operators import geometry, identify, pictures, sealing, survey
from blockwright.sources import images as source
from pyspark.sql import functions as F


def test_planted_fields_are_found(spark):
    """Records of a token, their own length at 8 and dates at 12 and 20."""
    rng = random.Random(1)
    buffers = []
    for b in range(4):
        out = b""
        for k in range(30):
            n = 32 + rng.randrange(60)
            head = b"RECX" + rng.randbytes(4).replace(b"R", b"_") + struct.pack("<III", n, images.packed(datetime(2020, 1, 1 + k % 28, k % 24)), 7) + struct.pack("<I", 1_500_000_000 + k)
            out += head + bytes(n - len(head))
        buffers.append((bytearray(out),))
    got = survey.token_fields(survey.token_geometry(spark.createDataFrame([*buffers, (None,)], "data binary").repartition(3), [b"RECX", b"NONE"])).orderBy("token").collect()
    assert (got[0]["places"], got[0]["length_offset"]) == (0, None)
    assert (got[1]["places"], got[1]["length_offset"], got[1]["length_width"], got[1]["length_share"]) == (120, 8, 4, 1.0)
    assert {("packed", 12, 1.0), ("unix", 20, 1.0)} <= {tuple(x) for x in got[1]["dates"]}


def test_overlapping_places():
    assert survey.geometry_of(b"aaaa", b"aa")[0, 0, :2].tolist() == [3, 2]


def test_buffers_together_equal_buffers_alone():
    """Fields and gaps end with their buffer, wherever buffers meet; many short ones take no longer than one of their size."""
    rng = random.Random(8)
    tokens = [b"ab", b"aa", b"b"]
    for _ in range(200):
        buffers = [bytes(rng.choice(b"ab\x02\x00") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        together = survey._geometry(np.frombuffer(b"".join(buffers), np.uint8), np.cumsum([len(b) for b in buffers]), tokens)
        for t, token in enumerate(tokens):
            assert (together[t] == sum(fields_by_hand(b, token) for b in buffers)).all()


def fields_by_hand(data, token):
    out = np.zeros((len(survey.OFFSETS), len(survey.WIDTHS), 5), np.int64)
    at = [k for k in range(len(data)) if data.startswith(token, k)]
    for p, after in zip(at, [*at[1:], None]):
        for i, offset in enumerate(survey.OFFSETS):
            for j, width in enumerate(survey.WIDTHS):
                field = data[p + offset : p + offset + width]
                value = np.array([int.from_bytes(field, "little")])
                whole = len(field) == width
                dated = whole and width == 4 and offset % 4 == 0
                out[i, j] += (1, after is not None, whole and after is not None and value[0] == after - p, dated and survey._is_unix(value)[0], dated and survey._is_packed(value)[0])
    return out


def found_by_hand(data, wanted):
    out = set()
    for name, form, pattern in wanted:
        rule = re.compile(re.escape(pattern), re.S) if form == "bytes" else re.compile(rb"(?<![0-9A-Za-z])(?=" + re.escape(pattern) + rb"(?![0-9A-Za-z]))", re.I)
        rule = re.compile(b"(?=" + re.escape(pattern) + b")", re.S) if form == "bytes" else rule
        out |= {(name, form, m.start()) for m in rule.finditer(data)}
    return out


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_identifiers_equal_brute_force(spark, tmp_path, block):
    rng = random.Random(3)
    macs = ["02-00-5e-10-00-01", "0200.5EAA.0002", "nonsense"]
    wanted = identify.forms([("text", "SN12345678"), ("text", "serial-77"), ("text", "short"), ("text", None), ("text", "ÄÖÜ12345"), *[("mac", m) for m in macs]])
    assert len(wanted) == 2 + 8 and wanted[2][0] == "02:00:5E:10:00:01"
    data = bytearray(rng.randbytes(6000))
    for k, (_, _, p) in enumerate(wanted * 3):
        piece = (b"x" if k % 4 == 3 else b" ") + (p.swapcase() if k % 2 and not k % 10 > 8 else p) + (b"9" if k % 7 == 6 else b".")
        at = 64 * (3 * k + 1) - 5  # across borders of small blocks
        data[at : at + len(piece)] = piece
    path = tmp_path / "disk.img"
    path.write_bytes(data)
    source.register(spark)
    blocks = spark.read.format("rawblocks").option("path", str(path)).option("blockSize", block).option("lookBehind", 1).option("lookAhead", 32).load()
    got = [tuple(r) for r in identify.identifier_hits(blocks, wanted).collect()]
    assert len(got) == len(set(got)) and set(got) == found_by_hand(bytes(data), wanted) and len(got) > 10
    told = {(r["identifier"], r["form"]): r["n"] for r in identify.identifier_report(spark, identify.identifier_hits(blocks, wanted), wanted).collect()}
    assert len(told) == len(wanted) and sum(told.values()) == len(got)


def test_ten_thousand_identifiers(spark, monkeypatch):
    rng = random.Random(5)
    names = sorted({f"id{rng.randrange(10**8):08d}" for _ in range(10_000)})
    text = " ".join(rng.choice(names) if rng.random() < 0.3 else f"id{rng.randrange(10**8)}" for _ in range(3000))
    blocks = spark.createDataFrame([(0, bytearray(text.encode()), None, None)], "offset long, content binary, before binary, after binary")
    wanted = identify.forms([("text", n) for n in names])
    at, places = set(names), []
    for m in re.finditer("[0-9a-z]+", text):
        if m[0] in at:
            places.append((m[0], "text", m.start()))
    for most in (1 << 17, 3000):  # one automaton, and four
        monkeypatch.setattr(identify, "MOST_FORMS", most)
        assert sorted(map(tuple, identify.identifier_hits(blocks, wanted).collect())) == sorted(places)


def by_hand(nals):
    units, seen = [], False
    for k, (kind, first) in enumerate(nals):
        slice_ = kind is not None and 1 <= kind <= 5
        if not units or (seen and (kind in (6, 7, 8, 9, 14, 15, 16, 17, 18) or (slice_ and first))):
            units.append([])
            seen = False
        units[-1].append(k)
        seen = seen or slice_
    return units


def test_pictures_equal_a_hand_count(spark):
    rng = random.Random(7)
    lanes = {v: [(rng.choice([1, 1, 5, 6, 7, 8, 9, 12, 14, None]), rng.choice([True, False, None])) for _ in range(200)] for v in range(3)}
    rows = [(v, k, *n) for v, nals in lanes.items() for k, n in enumerate(nals)]
    got = pictures.access_units(spark.createDataFrame(rows, "v long, at long, type int, first boolean").repartition(3), ["v"], "at", "type", "first", 16).collect()
    told = {(r["v"], r["at"]): r["picture"] for r in got}
    assert told == {(v, k): unit[0] for v, nals in lanes.items() for unit in by_hand(nals) for k in unit}


def test_picture_table_meets_each_row_twice(spark, monkeypatch):
    """Pictures over many stretches, null lanes, types and places among them, equal those of single rows; rows are shuffled by stretch once."""
    rng = random.Random(11)
    rows = [(v, 3 * k - 40, rng.choice([1, 5, 6, 9, 12, 12, 12, None]), rng.choice([True, False, None])) for v in (1, 2, None) for k in range(150) if rng.random() < 0.7]
    rows += [(4, k * 100, kind, False) for k, kind in enumerate([6, 1, 12, 6, 6, 5, 7])] + [(5, 7, 1, True), (1, None, 5, True)]
    units = spark.createDataFrame(rows, "v long, at long, type int, first boolean").repartition(3)
    for stretch in (1, 4, 16, 1000):
        every = pictures.access_units(units, ["v"], "at", "type", "first", stretch).groupBy("v", "picture")
        want = every.agg(F.count("*"), F.count_if(F.col("type").between(1, 5)), F.coalesce(F.bool_or(F.col("type") == 5), F.lit(False)), F.max("at"))
        got = pictures.picture_table(units, ["v"], "at", "type", "first", stretch)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    monkeypatch.setattr(pictures, "running_max", None)  # no row meets what stretches carry on
    plan = pictures.picture_table(units, ["v"], "at", "type", "first", 16)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(v") <= 4  # by stretch (for either branch, which share it), by lane, by picture


def test_sealed_blocks(spark):
    key, other = bytes(range(32)), bytes(32)
    rows = [(k, bytearray(os.urandom(500 + k) if k else b"")) for k in range(9)]
    blocks = spark.createDataFrame(rows, "index long, content binary")
    shut = sealing.sealed(blocks, key, "case-1").cache()
    assert {r["index"]: bytes(r["content"]) for r in sealing.unsealed(shut, key, "case-1").collect()} == {k: bytes(c) for k, c in rows}
    root = sealing.seal_root(shut).first()
    assert root["blocks"] == 9 and root["root"] != sealing.seal_root(shut.where("index < 8")).first()["root"] and sealing.seal_breaks(shut).isEmpty()
    swapped = shut.withColumn("index", F.when(F.col("index") == 3, 4).when(F.col("index") == 4, 3).otherwise(F.col("index")))
    assert {r["index"] for r in sealing.unsealed(swapped, key, "case-1").where("not ok").collect()} == {3, 4}
    changed = shut.withColumn("sealed", F.when(F.col("index") == 5, F.concat(F.expr("substring(sealed, 1, 30)"), F.lit(b"\0"), F.expr("substring(sealed, 32)"))).otherwise(F.col("sealed")))
    assert {r["index"] for r in sealing.unsealed(changed, key, "case-1").where("not ok").collect()} <= {5} and {r["reason"] for r in sealing.seal_breaks(changed).collect()} <= {"digest"}
    for k, p in ((other, "case-1"), (key, "case-2")):
        assert sealing.unsealed(shut, k, p).where("ok").isEmpty()
    assert {r["reason"] for r in sealing.seal_breaks(shut.where("index <> 2").unionByName(shut.where("index = 7"))).collect()} == {"missing", "twice"}
    with pytest.raises(ValueError):
        sealing.sealed(blocks, b"short", "x")


def test_similarity_equals_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(20):
        p, t = rng.normal(size=(5, 2)), rng.normal(size=(5, 2))
        rows.append(([tuple(map(float, x)) for x in p], [tuple(map(float, x)) for x in t]))
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double>>, t array<struct<x:double,y:double>>")
    for (p, t), r in zip(rows, df.select(geometry.similarity(F.col("p"), F.col("t")).alias("m")).collect(), strict=True):
        a = np.array([[x, -y, 1, 0] for x, y in p] + [[y, x, 0, 1] for x, y in p])
        want = np.linalg.lstsq(a, np.array([x for x, _ in t] + [y for _, y in t]), rcond=None)[0]
        assert np.allclose([r["m"]["a"], r["m"]["b"], r["m"]["x"], r["m"]["y"]], want)
    odd = spark.createDataFrame([([(1.0, 2.0)], [(1.0, 2.0)]), ([(1.0, 1.0)] * 2, [(0.0, 0.0), (1.0, 1.0)]), (None, None), ([(1.0, None), (2.0, 1.0)], [(0.0, 0.0), (1.0, 1.0)])], df.schema)
    assert [r[0] for r in odd.select(geometry.similarity(F.col("p"), F.col("t"))).collect()] == [None] * 4


def test_tiles_cover_and_overlap(spark):
    df = spark.createDataFrame([(w, w) for w in (1, 63, 64, 65, 100, 1000)] + [(0, 5), (None, 5)], "w int, h int")
    for w, rows in {w: [r for r in geometry.tiles(df, "w", "h", 64, 16).collect() if r["w"] == w] for w in (1, 63, 64, 65, 100, 1000, 0)}.items():
        xs = sorted({r["tile_x"] for r in rows})
        assert (not xs) if w == 0 else xs[0] == 0 and xs[-1] + min(64, w) == w and all(0 < b - a <= 48 for a, b in zip(xs, xs[1:], strict=False))
