"""Commands that read images and tables, run as a user would."""

import json

import images
from blockwright import cli


def rows(capsys, *args):
    capsys.readouterr()
    assert cli.main([*map(str, args)]) == 0
    return [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]


def test_image_commands(spark, tmp_path, capsys):
    disk = images.camera_disk(2, 40)[0] + b" SN12345678 " + bytes(500) + b"\x02\x00\x5e\x10\x00\x01"
    path, key, sealed = tmp_path / "disk.img", tmp_path / "key", tmp_path / "sealed"
    path.write_bytes(disk)
    key.write_bytes(bytes(range(32)))
    got = {r["tap"]: r["rows"] for r in rows(capsys, "scan-all", path, tmp_path / "scan", "--block", 8192)}
    assert got["map"] == -(-len(disk) // 8192) and got["frames"] == 80 and got["packs"] == 0
    found = {(r["identifier"], r["form"]): r["n"] for r in rows(capsys, "identify", path, "serial=sn12345678,mac=02-00-5E-10-00-01", "--block", 8192)}
    assert found["sn12345678", "text"] == 1 and found["02:00:5E:10:00:01", "bytes"] == 1 and sum(found.values()) == 2
    (field,) = rows(capsys, "survey", path, "DHAV", "--block", 65536)
    assert field["places"] >= 80 and field["length_offset"] == 12
    rows(capsys, "seal", path, key, "p1", "--block", 8192, "--out", sealed)
    assert [r["blocks"] for r in rows(capsys, "seal-check", sealed)] == [got["map"]]
    assert all(r["ok"] for r in rows(capsys, "unseal", sealed, key, "p1", "--show", 99)) and not any(r["ok"] for r in rows(capsys, "unseal", sealed, key, "p2"))


def test_table_commands(spark, tmp_path, capsys):
    save = lambda name, data, form: spark.createDataFrame(data, form).write.parquet(str(tmp_path / name))
    save("slots", [(0, 1, 1, 2, 0, 1), (0, 2, 2, 0, 1, 1)], "volume long, idx long, kind int, next long, prev long, seq long")
    assert [(r["head"], r["n"], r["note"]) for r in rows(capsys, "chains", tmp_path / "slots")] == [(1, 2, "")]
    save("heads", [(0, k, 1000 + 10 * k, 1009 + 10 * k, 0) for k in range(9)], "volume long, idx long, start_s long, end_s long, vol_start long")
    save("marks", [(0, 50 + 100 * k, 1000 + 10 * k, 1009 + 10 * k) for k in range(9)], "volume long, offset long, first_s long, last_s long")
    assert [r["base"] for r in rows(capsys, "calibrate", tmp_path / "heads", tmp_path / "marks", "--block", 100)] == [50]
    save("raw", [("2O24-02-01 10:20:30",), ("Gate O1",)], "raw string")
    assert [r.get("clock", {}).get("readings", [{}])[0].get("form") for r in rows(capsys, "read-clocks", tmp_path / "raw")] == ["yyyy-mm-dd", None]
    assert [r.get("form") for r in rows(capsys, "read-titles", tmp_path / "raw")][1] == "gate 01"
