import hashlib
import os
import zlib

import numpy as np
import pytest
from helpers import HARD, documents

from blockwright.llm import jpeg


def test_round_trip():
    for data in (b"", b"a", b"x" * 64, b"y" * 65, os.urandom(5000), b"\xff" * 300, bytes(range(256)) * 3):
        payload = jpeg.pad(data)
        assert len(payload) % 64 == 0 and payload[: len(data)] == data and jpeg.decode(jpeg.encode(payload))[0] == payload


def test_facts(spark):
    texts = [*HARD, "z" * 100_000]
    for r in jpeg.media_columns(documents(spark, texts), media=True).collect():
        data = (texts[r["id"]] or "").encode()
        payload = jpeg.pad(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert jpeg.media_columns(documents(spark, ["x"]).limit(0)).count() == 0


def variable(blocks, restart=0):
    """A baseline picture with ordinary run-length symbols and codes of several lengths."""
    dc = {s: 4 for s in range(12)}
    ac = {0x00: 2, 0xF0: 8} | {run << 4 | size: 8 if size > 2 else 6 for run in range(4) for size in range(1, 9)}

    def codes(lengths):
        out, code, prior = {}, 0, 0
        for s in sorted(lengths, key=lambda s: (lengths[s], s)):
            code <<= lengths[s] - prior
            prior = lengths[s]
            out[s] = (code, lengths[s])
            code += 1
        return out

    dcc, acc = codes(dc), codes(ac)
    bits, scan, last = "", b"", 0
    put = lambda c: format(c[0], f"0{c[1]}b")
    value = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") if bits else b""

    for n, block in enumerate(blocks):
        if restart and n and n % restart == 0:
            scan += flush(bits) + bytes((0xFF, 0xD0 + (n // restart - 1) % 8))
            bits, last = "", 0
        d = block[0] - last
        last = block[0]
        bits += put(dcc[abs(d).bit_length()]) + value(d)
        run = 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits, run = bits + put(acc[0xF0]), run - 16
            bits, run = bits + put(acc[run << 4 | abs(v).bit_length()]) + value(v), 0
        if run:
            bits += put(acc[0])
    return jpeg._header(8 * len(blocks), 8, b"", dc, ac, restart) + scan + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_ordinary_baseline_pictures(restart):
    rng = np.random.default_rng(1)
    blocks = []
    for _ in range(5):
        b = [int(rng.integers(-500, 500))] + [0] * 63
        for k in (1, 2, 4, 8, 24 if restart else 9):
            b[k] = int(rng.integers(-200, 200))
        if restart:
            b[24] = 0
        blocks.append(b)
    payload, p, small = jpeg.decode(variable(blocks, restart))
    assert payload is None and (jpeg.coefficients(p) == np.array(blocks)).all() and small.shape == (1, 5)
    assert (small[0] == np.clip(np.rint(np.array([b[0] for b in blocks]) / 8 + 128), 0, 255)).all()


def test_broken_pictures():
    good = jpeg.encode(jpeg.pad(b"some bytes" * 30))
    for bad in (b"", b"\xff\xd8", good[:40], good.replace(b"\xff\xc0", b"\xff\xc2"), good[:-20]):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode(bad)


def test_stored_order_is_the_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_pictures_of_several_runs(monkeypatch):
    rng = np.random.default_rng(2)
    payloads = [jpeg.pad(rng.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (64, 640, 5000, 64, 3000, 40000)] + [bytes(6400), b"\xff" * 6400]
    whole = jpeg.encode_all(payloads)
    assert [p for p, *_ in jpeg.decode_all(whole)] == payloads == [jpeg.decode(jpeg.encode(p))[0] for p in payloads]
    monkeypatch.setattr(jpeg, "BLOCKS", 16)
    assert jpeg.encode_all(payloads) == whole and [p for p, *_ in jpeg.decode_all(whole)] == payloads
    p = jpeg.parse(whole[-3])
    raw = np.frombuffer(p["scan"], np.uint8)
    marks = raw[jpeg._marks(raw) + 1] - 0xD0
    assert (marks == np.arange(len(marks)) % 8).all() and len(marks) == len(payloads[-3]) // 64 + 8 - 1 or len(marks) >= len(payloads[-3]) // 64 - 1


def test_codes_have_several_lengths():
    used = {n for _, n, _ in jpeg.parse(jpeg.encode(jpeg.pad(b"text")))["ac"][0].codes}
    assert {1, 2, 3, 15} <= used


def test_texts_equal_a_decoder_of_bits():
    """The scan of a text, read bit by bit."""
    payload = jpeg.pad(bytes(range(200)) + bytes(90) + b"plain text")
    p = jpeg.parse(jpeg.encode(payload))
    raw, starts, ends = jpeg._intervals(np.frombuffer(p["scan"], np.uint8))
    tables = [{(format(c, f"0{n}b")): s for c, n, s in p[k][0].codes} for k in ("dc", "ac")]
    rows = []
    for a, b in zip(starts, ends):
        bits, at, block = "".join(format(x, "08b") for x in raw[a:b]), 0, []
        while len(block) < 64:
            n = next(n for n in range(1, 17) if bits[at : at + n] in tables[bool(block)])
            s, at = tables[bool(block)][bits[at : at + n]], at + n
            if block and s == 0:
                block += [0] * (64 - len(block))
                break
            size = s & 15
            v = int(bits[at : at + size], 2) if size else 0
            block += [0] * (s >> 4 if len(block) else 0) + [v if not size or v >> (size - 1) else v - (1 << size) + 1]
            at += size
        rows.append(block)
        assert set(bits[at:]) <= {"1"} and len(bits) - at < 8
    assert np.array(rows, np.int8).tobytes()[: len(payload)] == payload
