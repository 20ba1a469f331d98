"""Media columns as baseline JPEG: 64 payload bytes are the 64 coefficients of one block.

The writer stores bytes losslessly as quantised coefficients, coded as in any baseline picture: a Huffman code for the
number of zeros ahead and the size of the value, then the value's bits, an end of block after the last one. Every
block is a restart interval of its own. The reader is a baseline decoder: it parses the markers, removes stuffing and
decodes code by code. Restart intervals are independent of each other, so the intervals of many pictures with the same
tables take their steps together in numpy; a picture with few of them is decoded alone. The direct-current
coefficients give a luminance thumbnail of one pixel per block without an inverse transform.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_runs, tidy

RUN_BYTES = 2 << 20
#: Blocks that are coded or decoded at once.
BLOCKS = 1 << 13
#: Code lengths by a rule: what texts hold most has 1, 2, 3, ... bits, all other symbols 15.
DC_LENGTHS = {size: k + 1 for k, size in enumerate((7, 6, 8, 5, 4, 3, 2, 1, 0, 9, 10, 11))}
_FIRST = (0x07, 0x06, 0x08, 0x00, 0x05, 0x04, 0x03)
AC_LENGTHS = {s: 15 for s in (0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11)))} | {s: k + 1 for k, s in enumerate(_FIRST)}
#: The order in which a block's coefficients are stored: by anti-diagonals, in turning direction.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Most blocks in one direction: 65,535 samples.
MOST = 8191


class JpegError(ValueError):
    """The bytes are no baseline JPEG that this reader knows."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    """DHT of a class and id with these symbols' code lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind]) + bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(order)


def _header(width: int, height: int, app: bytes, dc: dict[int, int], ac: dict[int, int], restart: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xEB, app), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
        _segment(0xC4, _table(0x00, dc)), _segment(0xC4, _table(0x10, ac)),
        _segment(0xDD, struct.pack(">H", restart)) if restart else b"", _segment(0xDA, bytes((1, 1, 0, 0, 63, 0))),
    ))


def pad(data: bytes) -> bytes:
    """The bytes, with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def _codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol, of the canonical code with these lengths."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for value, n, symbol in Huffman.of(_table(0, lengths)[1:]).codes:
        code[symbol], size[symbol] = value, n
    return code, size


def _scans(rows: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Scans of pictures whose blocks (coefficients in stored order) follow one another; last tells a picture's last block."""
    size = np.zeros_like(rows)
    for k in range(8):
        size[np.abs(rows) >= 1 << k] = k + 1
    place = np.arange(64)
    used = np.where((rows != 0) | (place == 0), place, 0)
    before = np.zeros_like(rows)
    before[:, 1:] = np.maximum.accumulate(used, axis=1)[:, :-1]  # the last value ahead of each place
    run, final = place - before - 1, used.max(axis=1, keepdims=True)
    (dc, dc_size), (ac, ac_size) = _codes(DC_LENGTHS), _codes(AC_LENGTHS)
    symbol = (run & 15) << 4 | size
    code = ac[symbol] << size | (rows + np.where(rows < 0, (1 << size) - 1, 0))
    bits = ac_size[symbol] + size
    skip = (rows == 0) & (place < final) & ((place - before) % 16 == 0)  # sixteen zeros ahead of a value
    end = place == final + 1
    code = np.where(rows != 0, code, np.where(skip, ac[0xF0], np.where(end, ac[0x00], 0)))
    bits = np.where(rows != 0, bits, np.where(skip, ac_size[0xF0], np.where(end, ac_size[0x00], 0)))
    first = rows[:, 0]
    code[:, 0] = dc[size[:, 0]] << size[:, 0] | (first + np.where(first < 0, (1 << size[:, 0]) - 1, 0))
    bits[:, 0] = dc_size[size[:, 0]] + size[:, 0]

    total = bits.sum(axis=1)
    many = -(-total // 8)
    start = np.cumsum(many) - many
    at = (start * 8)[:, None] + np.cumsum(bits, axis=1) - bits
    flat = np.zeros(int(many.sum()) * 8, np.uint8)
    for k in range(7):  # a block's last byte is filled up with ones
        filled = total % 8 > 0
        spots = (start * 8 + total)[filled] + k
        flat[spots[spots < ((start + many) * 8)[filled]]] = 1
    code, bits, at = code.ravel(), bits.ravel(), at.ravel()
    for k in range(int(bits.max(initial=0))):
        live = np.flatnonzero(bits > k)
        code, bits, at = code[live], bits[live], at[live]
        flat[at + k] = code >> (bits - 1 - k) & 1
    coded = np.packbits(flat)
    # A zero byte follows each byte of ones, and a restart marker each block.
    full = coded == 0xFF
    block = np.repeat(np.arange(len(rows)), many)
    spot = np.arange(len(coded)) + np.cumsum(full) - full + 2 * block
    out = np.zeros(len(coded) + int(full.sum()) + 2 * len(rows), np.uint8)
    out[spot] = coded
    ends = spot[start + many - 1] + 1 + full[start + many - 1]
    index = np.arange(len(rows))
    number = index - np.maximum.accumulate(np.where(np.concatenate(([True], last[:-1])), index, 0))
    out[ends], out[ends + 1] = 0xFF, 0xD0 + number % 8
    cuts = np.concatenate(([0], ends[last] + 2))
    return [out[a : b - 2].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _shape(n: int) -> tuple[int, int]:
    wide = min(MOST, math.isqrt(n - 1) + 1)
    high = -(-n // wide)
    if high > MOST:
        raise JpegError("the payload is larger than the format's largest picture")
    return wide, high


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload, whose coefficients are its bytes; lengths must be positive multiples of 64."""
    shapes = [_shape(len(x) // 64) for x in payloads]
    many = np.array([w * h for w, h in shapes], np.int64)
    parts: list[list[bytes]] = [[] for _ in payloads]
    rows = np.zeros((int(many.sum()), 64), np.int8)
    ends = np.cumsum(many)
    for x, end, n in zip(payloads, ends.tolist(), many.tolist()):
        rows[end - n : end].reshape(-1)[: len(x)] = np.frombuffer(x, np.int8)
    for at in range(0, len(rows), BLOCKS):
        own = rows[at : at + BLOCKS]
        owner = np.searchsorted(ends, np.arange(at, at + len(own)), side="right")
        last = np.append(owner[1:] != owner[:-1], True)
        for k, scan in zip(owner[last].tolist(), _scans(own.astype(np.int64), last)):
            parts[k].append(scan)
    # A picture that goes on in the next run of blocks goes on with the next marker, BLOCKS being a multiple of eight.
    out, begin = [], 0
    for x, (wide, high), scans, n in zip(payloads, shapes, parts, many.tolist()):
        done = min(n, BLOCKS - begin % BLOCKS)
        body = scans[0]
        for scan in scans[1:]:
            body += bytes((0xFF, 0xD0 + (done - 1) % 8)) + _renumbered(scan, done)
            done += BLOCKS
        begin += n
        out.append(_header(wide * 8, high * 8, b"PAYLOAD\0" + struct.pack(">Q", len(x)), DC_LENGTHS, AC_LENGTHS, 1) + body + b"\xff\xd9")
    return out


def _renumbered(scan: bytes, first: int) -> bytes:
    """The scan with its restart markers numbered on from ``first``."""
    if first % 8 == 0:
        return scan
    raw = np.frombuffer(scan, np.uint8).copy()
    marks = _marks(raw) + 1
    raw[marks] = 0xD0 + (raw[marks].astype(np.int64) - 0xD0 + first) % 8
    return raw.tobytes()


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


class Huffman:
    """Canonical codes of one table, as a look-up over the next 16 bits."""

    def __init__(self, counts: bytes, syms: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code, k, self.codes = 0, 0, []
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                if k >= len(syms) or code >= 1 << n:
                    raise JpegError("a Huffman table is over-full")
                first = code << (16 - n)
                self.length[first : first + (1 << (16 - n))] = n
                self.symbol[first : first + (1 << (16 - n))] = syms[k]
                self.codes.append((code, n, syms[k]))
                code, k = code + 1, k + 1
            code <<= 1

    @staticmethod
    @lru_cache(maxsize=16)
    def of(body: bytes) -> Huffman:
        """The table whose counts and symbols these bytes are."""
        return Huffman(body[:16], body[16:])


def parse(data: bytes) -> dict:
    """Frame, tables, restart interval and the scan's bytes of a baseline JPEG of one component."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    out: dict = {"quant": {}, "dc": {}, "ac": {}, "restart": 0, "app": b""}
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("no marker where one must be")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise JpegError("a segment is cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                if len(body) < (129 if wide else 65):
                    raise JpegError("a quantisation table is cut off")
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 129 if wide else 65], ">u2" if wide else np.uint8)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                if len(body) < 17 + total:
                    raise JpegError("a Huffman table is cut off")
                out["ac" if body[0] >> 4 else "dc"][body[0] & 15] = Huffman.of(body[1 : 17 + total])
                body = body[17 + total :]
        elif marker in (0xC0, 0xC1):
            bits, out["height"], out["width"], parts = struct.unpack(">BHHB", body[:6])
            if bits != 8 or parts != 1 or not out["height"] or not out["width"]:
                raise JpegError("only 8-bit pictures of one component are read")
            out["quant_id"] = body[8]
        elif 0xC2 <= marker <= 0xCF:
            raise JpegError("no baseline frame")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEB:
            out["app"] = body
        elif marker == 0xDA:
            out["tables"] = (body[2] >> 4, body[2] & 15)
            end = data.rfind(b"\xff\xd9")
            out["scan"] = data[at : end if end >= at else len(data)]
            if "width" not in out:
                raise JpegError("a scan without a frame")
            return out


def _marks(raw: np.ndarray) -> np.ndarray:
    """Where restart markers are."""
    return np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) > 1 else np.zeros(0, np.int64)


def _intervals(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, starts, ends) of a scan's restart intervals."""
    marks = _marks(raw)
    keep = np.ones(len(raw), bool)
    keep[1:][(raw[:-1] == 0xFF) & (raw[1:] == 0)] = False
    keep[marks] = keep[marks + 1] = False
    place = np.concatenate(([0], np.cumsum(keep)))
    return raw[keep], place[np.concatenate(([0], marks + 2))], place[np.append(marks, len(raw))]


def _value(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def _slow_interval(data: bytes, dc: Huffman, ac: Huffman, blocks: int) -> list[list[int]]:
    """Coefficients of an interval, code by code."""
    stream = int.from_bytes(data, "big")
    total, at, prior, out = len(data) * 8, 0, 0, []

    def take(n: int) -> int:
        nonlocal at
        if at + n > total:
            raise JpegError("the scan is cut off")
        at += n
        return (stream >> (total - at)) & ((1 << n) - 1)

    def symbol(table: Huffman) -> int:
        nonlocal at
        left = total - at
        ahead = (stream >> (left - 16)) & 0xFFFF if left >= 16 else ((stream & ((1 << left) - 1)) << (16 - left)) | ((1 << (16 - left)) - 1)
        n = int(table.length[ahead])
        if not n or n > left:
            raise JpegError("no such Huffman code")
        at += n
        return int(table.symbol[ahead])

    for _ in range(blocks):
        block = [0] * 64
        size = symbol(dc)
        prior += _value(take(size), size)
        block[0], k = prior, 1
        while k < 64:
            s = symbol(ac)
            run, size = s >> 4, s & 15
            if not size:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            if k > 63:
                raise JpegError("a run leaves its block")
            block[k] = _value(take(size), size)
            k += 1
        out.append(block)
    return out


def _together(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, dc: Huffman, ac: Huffman) -> np.ndarray:
    """Coefficients of all blocks of intervals that take their steps together; blocks says how many each has."""
    padded = np.concatenate((data, np.full(8, 0xFF, np.uint8))).astype(np.int64)
    ahead = sum(padded[k : len(padded) - 4 + k] << (8 * (4 - k)) for k in range(5))  # the forty bits from each byte on
    out = np.zeros((int(blocks.sum()), 64), np.int32)
    first, at, limit = np.cumsum(blocks) - blocks, starts * 8, ends * 8
    prior = np.zeros(len(starts), np.int64)

    def step(own: np.ndarray, table: Huffman):
        """(symbol, value) at the places of intervals, which move on."""
        now = at[own]
        window = ahead[np.minimum(now >> 3, len(ahead) - 1)] >> (8 - (now & 7))  # 32 bits
        look = window >> 16 & 0xFFFF
        n, symbol = table.length[look], table.symbol[look]
        if not n.all():
            raise JpegError("no such Huffman code")
        size = symbol & 15
        bits = window >> (32 - n - size) & ((1 << size) - 1)
        at[own] = now + n + size
        return symbol, size, np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << size) + 1, bits)

    for k in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > k)
        symbol, _, value = step(live, dc)
        if (symbol > 11).any():
            raise JpegError("no such size")
        prior[live] += value
        out[first[live] + k, 0] = prior[live]
        place = np.ones(len(live), np.int64)
        while len(live):
            symbol, size, value = step(live, ac)
            if (size > 10).any():
                raise JpegError("no such size")
            place += symbol >> 4
            held = size > 0
            if (place[held] > 63).any():
                raise JpegError("a run leaves its block")
            out[first[live[held]] + k, place[held]] = value[held]
            place += 1
            go = (held | (symbol == 0xF0)) & (place < 64)
            live, place = live[go], place[go]
    if (at > limit).any():
        raise JpegError("the scan is cut off")
    return out


def _frame(p: dict) -> tuple[int, int]:
    """(blocks, blocks of an interval)"""
    blocks = -(-p["width"] // 8) * -(-p["height"] // 8)
    return blocks, p["restart"] or blocks


def coefficients_all(pictures: list[dict]) -> list[np.ndarray]:
    """(blocks, 64) quantised coefficients in stored order, for each parsed picture."""
    out: list[np.ndarray | None] = [None] * len(pictures)
    alike: dict = {}
    for k, p in enumerate(pictures):
        blocks, each = _frame(p)
        try:
            dc, ac = p["dc"][p["tables"][0]], p["ac"][p["tables"][1]]
        except KeyError:
            raise JpegError("a Huffman table is missing") from None
        raw, starts, ends = _intervals(np.frombuffer(p["scan"], np.uint8))
        many = np.minimum(each, blocks - each * np.arange(len(starts)))
        if len(starts) != -(-blocks // each):
            raise JpegError("blocks are missing")
        if blocks > 16 * len(starts):  # too few intervals to gain by steps together
            out[k] = np.array([row for a, b, n in zip(starts, ends, many.tolist()) for row in _slow_interval(raw[a:b].tobytes(), dc, ac, n)], np.int32)
        else:
            alike.setdefault((id(dc), id(ac)), (dc, ac, []))[2].append((k, raw, starts, ends, many))
    for dc, ac, parts in alike.values():
        base = np.cumsum([0, *(len(raw) for _, raw, *_ in parts)])
        data = np.concatenate([raw for _, raw, *_ in parts])
        starts = np.concatenate([x[2] + b for x, b in zip(parts, base)])
        ends = np.concatenate([x[3] + b for x, b in zip(parts, base)])
        many = np.concatenate([x[4] for x in parts])
        rows = np.concatenate([_together(data[starts[a] : ends[min(a + BLOCKS, len(ends)) - 1]], starts[a : a + BLOCKS] - starts[a], ends[a : a + BLOCKS] - starts[a], many[a : a + BLOCKS], dc, ac) for a in range(0, len(starts), BLOCKS)])
        at = 0
        for k, *_, own in parts:
            out[k] = rows[at : at + int(own.sum())]
            at += int(own.sum())
    return out


def coefficients(p: dict) -> np.ndarray:
    return coefficients_all([p])[0]


def thumbnail(p: dict, coefs: np.ndarray) -> np.ndarray:
    """One luminance pixel per block, from its direct-current coefficient alone."""
    quant = int(p["quant"][p["quant_id"]][0]) if p["quant_id"] in p["quant"] else 1
    wide = -(-p["width"] // 8)
    return np.clip(np.rint(coefs[:, 0] * quant / 8 + 128), 0, 255).astype(np.uint8).reshape(-1, wide)


def decode_all(pictures: list[bytes]) -> list[tuple[bytes | None, dict, np.ndarray]]:
    """For each picture its payload (null if it holds none), the parsed markers and the thumbnail."""
    parsed, out = [parse(x) for x in pictures], []
    for p, coefs in zip(parsed, coefficients_all(parsed)):
        payload = None
        if p["app"].startswith(b"PAYLOAD\0"):
            payload = coefs.astype(np.int8).tobytes()[: struct.unpack(">Q", p["app"][8:16])[0]]
        out.append((payload, p, thumbnail(p, coefs)))
    return out


def decode(data: bytes) -> tuple[bytes | None, dict, np.ndarray]:
    return decode_all([data])[0]


def average_hash(small: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than its mean."""
    high, wide = small.shape
    ys, xs = (np.arange(8) * high) // 8, (np.arange(8) * wide) // 8
    if high >= 8 and wide >= 8:
        sums = np.add.reduceat(np.add.reduceat(small, ys, axis=0, dtype=np.int64), xs, axis=1, dtype=np.int64)
        cells = sums / np.outer(np.diff([*ys, high]), np.diff([*xs, wide]))
    else:
        cells = small[np.ix_(ys, xs)].astype(float)
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _facts(data: bytes, media: bytes, read: tuple) -> dict:
    payload, p, small = read
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return {
        "n_bytes": len(data), "payload_bytes": len(payload), "payload_sha256": sha(payload), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media), "media_sha256": sha(media),
        "feature": f"{p['width']}x{p['height']}:{average_hash(small)}:{sha(small.tobytes())[:16]}",
    }


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """(id, ...facts read back from the stored picture) for every document; with ``media`` also the picture itself.

    A null or empty text is 64 zero bytes. Equal texts give equal values, so ties are equal throughout. Null ids and
    repeated rows stay; an empty table gives no rows. A long text is coded and decoded in runs of blocks; one above the
    format's largest picture, 4 GB, is an error. The feature holds the picture's dimensions, the thumbnail's average
    hash and the start of its SHA-256.
    """

    def run(batches):
        fields = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for batch in batches:
            for part in text_runs(batch, 1, RUN_BYTES):
                texts = pc.fill_null(part.column(1), "").cast(pa.binary()).to_pylist()
                pictures = encode_all([pad(t) for t in texts])
                rows = [_facts(*x) for x in zip(texts, pictures, decode_all(pictures))]
                facts = pa.RecordBatch.from_pylist(rows, schema=fields)
                more = [pa.array(pictures, pa.binary())] if media else []
                yield pa.RecordBatch.from_arrays([part.column(0), *facts.columns, *more], names=["id", *fields.names, *["media"] * media])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(tidy(run), f"id {dict(chosen.dtypes)['id']}, {SCHEMA}" + ", media binary" * media)
