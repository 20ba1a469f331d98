"""One-pass facts, the ledger, clips, and the command line."""

import hashlib
import json

import images as made

from blockwright import cli
from blockwright.operators import carve, integrity
from blockwright.sources import facts, images
from pyspark.sql import functions as F


def disk(tmp_path):
    data = made.camera_disk(2, 60)[0] + made.program_stream([(90_000, 40)]) + bytes(9000)
    (tmp_path / "disk.img").write_bytes(data)
    return data, str(tmp_path / "disk.img")


def test_facts_inside_the_reader_equal_those_over_blocks(spark, tmp_path):
    data, path = disk(tmp_path)
    images.register(spark)
    for fused, plain, ahead in ((facts.frames, carve.frames, carve.LARGEST), (facts.packs, carve.packs, carve.PACK_AHEAD)):
        blocks = spark.read.format("rawblocks").option("path", path).option("blockSize", 4096).option("lookAhead", ahead).load()
        a, b = fused(spark, path, 4096, 2), plain(blocks)
        assert a.count() > 30 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_block_map_and_proofs(spark, tmp_path):
    data, path = disk(tmp_path)
    rows = facts.block_map(spark, path, 4096, 3)
    got = rows.orderBy("index").collect()
    assert [r["sha256"] for r in got] == [hashlib.sha256(data[k : k + 4096]).hexdigest() for k in range(0, len(data), 4096)]
    leaves = rows.select(F.col("index").alias("i"), F.col("sha256").alias("h"))
    level = [bytes.fromhex(r["sha256"]) for r in got]
    while len(level) > 1:
        level = [hashlib.sha256(level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    root = level[0].hex()
    assert integrity.merkle_root(leaves, width=2).first()["root"] == root
    proofs = integrity.merkle_proof(leaves, leaves)
    assert {r["r"] for r in proofs.select(integrity.verify_proof(F.col("h"), F.col("path")).alias("r")).collect()} == {root}
    assert integrity.merkle_root(leaves.limit(0)).first()["root"] == ""
    regions = spark.createDataFrame([("a", 0, 5000), ("b", 4096, 4097), ("none", 9, 9)], "name string, start long, end long")
    assert {r["index"]: r["regions"] for r in facts.preserved(rows, regions).collect()} == {0: ["a"], 1: ["a", "b"]}


def test_hashes_and_clips(spark, tmp_path):
    data, path = disk(tmp_path)
    h = facts.whole_hashes(spark, path).first()
    assert h["sha256"] == hashlib.sha256(data).hexdigest() and h["complete"]
    streams = carve.carve_streams(facts.frames(spark, path))
    clips = facts.write_clips(streams, path, str(tmp_path / "clips"), "sid", "extents", ".dav").collect()
    assert len(clips) == 2
    for c in clips:
        raw = open(c["file"], "rb").read()
        assert len(raw) == c["bytes"] and hashlib.sha256(raw).hexdigest() == c["sha256"] and len(carve.frames_in(raw, 0, len(raw))) == 60


def test_ledger(tmp_path):
    path = str(tmp_path / "ledger.jsonl")
    book = facts.Ledger(path)
    for k in range(4):
        book.append("scan", {"n": k, "ü": None}, "me", f"2024-01-01T00:00:0{k}Z")
    seal = book.seal(b"key")
    assert book.first_break() is None
    lines = open(path, encoding="utf-8").read().splitlines()
    for change, want in ((lambda x: [x[0], x[1].replace('"n":1', '"n":7'), *x[2:]], (1, "content")), (lambda x: [x[0], *x[2:]], (1, "sequence")), (lambda x: [x[0], json.dumps(json.loads(x[1]) | {"prev_hash": "0" * 64}), *x[2:]], (1, "link"))):
        open(path, "w", encoding="utf-8").write("\n".join(change(lines)) + "\n")
        assert book.first_break() == want
    open(path, "w", encoding="utf-8").write("\n".join(lines[:-1]) + "\n")
    assert book.first_break() is None and book.seal(b"key") != seal


def test_chain_verification(spark):
    rows, prior = [], "0" * 64
    for k in range(5):
        own = hashlib.sha256(f"{k}|{prior}|body{k}".encode()).hexdigest()
        rows.append((k, prior, f"body{k}", own))
        prior = own
    check = lambda r: tuple(integrity.verify_chain(spark.createDataFrame(r, "seq long, prev_hash string, body string, entry_hash string")).first())
    assert check(rows) == (5, None, None)
    assert check([*rows[:2], (2, rows[2][1], "other", rows[2][3]), *rows[3:]]) == (5, 2, "content")
    assert check([*rows[:2], *rows[3:]])[1:] == (3, "sequence")


def test_command_line(spark, tmp_path, capsys):
    _, path = disk(tmp_path)
    assert cli.main(["scan", path, "--block", "4096", "--out", str(tmp_path / "map")]) == 0
    for args in (["regions", str(tmp_path / "map")], ["diff", str(tmp_path / "map"), str(tmp_path / "map")], ["prove", str(tmp_path / "map"), "3"], ["carve", path], ["carve-ps", path], ["carve-annexb", path, "--block", "4096"], ["log", path], ["index", path], ["parse", path], ["partitions", path], ["hashes", path], ["query", "a3_weakest_status", "/root/testdata/sf0.001"], ["ledger", str(tmp_path / "l"), "--action", "x"]):
        assert cli.main(args) == 0, args
    assert '"root"' in capsys.readouterr().out
