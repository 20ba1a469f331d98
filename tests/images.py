"""Small disk images with known contents, made here for the tests."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from datetime import datetime, timedelta


def packed(t: datetime) -> int:
    return t.second | t.minute << 6 | t.hour << 12 | t.day << 17 | t.month << 22 | (t.year - 2000) << 26


def frame(kind: int, number: int, t: datetime, ms: int, body: bytes) -> bytes:
    length = 24 + len(body) + 8
    head = struct.pack("<4sBBBBIIIHB", b"DHAV", kind, 0, 0, 0, number, length, packed(t), ms & 0xFFFF, 0)
    return head + bytes([sum(head) & 0xFF]) + body + b"dhav" + struct.pack("<I", length)


def camera_disk(cameras: int = 2, frames: int = 60, cluster: int = 8192, seed: int = 3) -> tuple[bytes, dict]:
    """Cameras that write clusters in turn; some garbage with a bare magic between them."""
    rng = random.Random(seed)
    streams = []
    for c in range(cameras):
        start = datetime(2024, 3, 1 + c, 10 + c, 0, 0)
        out = []
        for n in range(frames):
            t = start + timedelta(milliseconds=400 * n)
            out.append(frame(0xFD if n % 10 == 0 else 0xFC, 1000 * c + n, t, 400 * n, rng.randbytes(300 + rng.randrange(300))))
        streams.append(out)
    disk, truth = bytearray(), {c: 0 for c in range(cameras)}
    at = [0] * cameras
    while any(a < frames for a in at):
        for c in range(cameras):
            part = b""
            while at[c] < frames and len(part) + len(streams[c][at[c]]) <= cluster:
                part += streams[c][at[c]]
                at[c] += 1
                truth[c] += 1
            disk += part + (b"DHAV" + rng.randbytes(20) + bytes(max(0, cluster - len(part) - 24)))
    return bytes(disk), truth


def pack(clock: int, payload: bytes) -> bytes:
    head = bytearray(b"\x00\x00\x01\xba" + bytes(10))
    head[4] = 0x44 | (clock >> 30 & 7) << 3 | clock >> 28 & 3
    head[5] = clock >> 20 & 0xFF
    head[6] = (clock >> 15 & 31) << 3 | 4 | clock >> 13 & 3
    head[7] = clock >> 5 & 0xFF
    head[8] = (clock & 31) << 3 | 4
    head[9], head[13] = 1, 0xF8
    return bytes(head) + b"\x00\x00\x01\xe0" + struct.pack(">H", len(payload)) + payload


def program_stream(runs: list[tuple[int, int]], seed: int = 5) -> bytes:
    """Runs of (first clock, packs), each pack 3,600 ticks on; bytes that fit no pack stand between runs."""
    rng, out = random.Random(seed), b""
    for first, many in runs:
        for k in range(many):
            out += pack((first + 3600 * k) % (1 << 33), bytes(b | 4 for b in rng.randbytes(200)))
        out += b"\x00\x00\x01\xba" + b"garbage" * 9
    return out


def leaf(channel: int, start: int, end: int, place: int) -> bytes:
    row = bytearray(48)
    row[:8] = b"\xff" * 8
    row[0x11] = channel
    struct.pack_into("<II", row, 0x18, start, end)
    struct.pack_into("<Q", row, 0x20, place)
    return bytes(row)


def log_record(t: int, major: int, minor: int, body: bytes = b"") -> bytes:
    return struct.pack("<4sIIHH", b"RATS", 1, t, major, minor) + body


def section(kind: bytes, at: int, body: bytes, last: bool = False) -> bytes:
    size = 76 + len(body)
    head = kind.ljust(16, b"\0") + struct.pack("<QQ", at if last else at + size, size) + bytes(40)
    return head + struct.pack("<I", zlib.adler32(head)) + body


def e01(media: bytes, sector: int = 512, per_chunk: int = 8) -> bytes:
    """One segment: chunks stored and compressed in turn, with stored hashes."""
    chunk, out = sector * per_chunk, b"EVF\x09\x0d\x0a\xff\x00" + b"\x01\x01\x00\x00\x00"
    volume = bytearray(1052)
    struct.pack_into("<II", volume, 8, per_chunk, sector)
    struct.pack_into("<Q", volume, 16, len(media) // sector)
    out += section(b"volume", len(out), bytes(volume))
    base, entries, body = len(out) + 76, [], b""
    for k in range(0, len(media), chunk):
        piece = media[k : k + chunk]
        if k // chunk % 2:
            entries.append(base + len(body))
            body += piece + struct.pack("<I", zlib.adler32(piece))
        else:
            entries.append((base + len(body)) | 1 << 31)
            body += zlib.compress(piece)
    out += section(b"sectors", len(out), body)
    table = struct.pack("<I4xQ4xI", len(entries), 0, 0) + b"".join(struct.pack("<I", e) for e in entries)
    out += section(b"table", len(out), table)
    out += section(b"digest", len(out), hashlib.md5(media).digest() + hashlib.sha1(media).digest() + bytes(44))
    return out + section(b"done", len(out), b"", last=True)


def partitioned(gpt: bool) -> bytes:
    head = bytearray(64 * 512)
    struct.pack_into("<B3xBBBBII", head, 446, 0, 0xEE if gpt else 0x0C, 0, 0, 0, 1 if gpt else 2048, 9999)
    head[510:512] = b"\x55\xaa"
    if gpt:
        head[512:520] = b"EFI PART"
        struct.pack_into("<QII", head, 512 + 72, 2, 4, 128)
        entry = bytearray(128)
        entry[:16] = b"\1" * 16
        struct.pack_into("<QQ", entry, 32, 100, 199)
        entry[56:64] = "ring".encode("utf-16-le")
        head[1024:1152] = entry
    return bytes(head)
