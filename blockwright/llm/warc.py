"""Legacy archives: ARC version 1 and 2 to WARC, identical payloads as revisits, and reading WARC back.

An ARC file opens with a ``filedesc`` record that names its version and so the fields of every header line; the
last field of a line is the record's declared length, which alone says where the next record starts. The converter
turns each record into a WARC record with an identifier derived from its content, an ISO date, a type by its scheme
and digests. Archives are written by Spark's text sink, whose line separator is the end of a WARC record, into the
shared folder, and read back as whole files of bounded size. Of payloads that are equal within an archive one alone
moves on; which record is a response is settled among the digests, in parts for those that many records share.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path, text_runs, tidy

#: Field names of a header line, by the version in the filedesc record (fixed values).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Payloads below this size are always stored.
LEAST_BYTES = 100
#: Bytes of an ARC archive and of a stretch of WARC records (one larger record is a stretch of its own), and stretches of a file.
SHARD_BYTES, FILE_STRETCHES = 4 << 20, 8
#: Digests of more than one of so many records are hot: their records are dealt into so many parts.
PARTS = 64
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
EPOCH = "20000101000000"


class ArchiveError(ValueError):
    """The bytes break the archive format."""


def arc_header(version: int, name: str) -> bytes:
    body = f"{version} 0 blockwright\n{' '.join(ARC_FIELDS[version])}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, content: bytes, kind: str = "text/html") -> bytes:
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "unknown:"
    extra = "" if version == 1 else f" 200 {hashlib.md5(content).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {EPOCH} {kind}{extra} {len(content)}\n".encode() + content + b"\n"


def parse_arc(data: bytes):
    """(fields of the header line, content) of each record, the filedesc record first."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError("a header line without an end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        try:
            size = int(line[-1])
        except ValueError:
            raise ArchiveError("a header line without a length") from None
        content = data[end + 1 : end + 1 + size]
        if size < 0 or len(content) != size:
            raise ArchiveError("a record is shorter than it declares")
        if fields is None:
            try:
                version = int(content.split(b" ", 1)[0])
                fields = ARC_FIELDS[version]
            except (ValueError, KeyError):
                raise ArchiveError("no known version") from None
        if len(line) != len(fields):
            raise ArchiveError("a header line has the wrong number of fields")
        yield dict(zip(fields, line)), content
        at = end + 1 + size


def iso_date(stamp: str) -> str:
    """A 14-digit ARC date as WARC wants it; shorter stamps are filled up."""
    s = (re.sub(r"\D", "", stamp) + EPOCH[len(stamp) :])[:14]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and payload."""
    head, mark, body = content.partition(b"\r\n\r\n")
    return (head + mark, body) if mark and head.startswith(b"HTTP/") else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode() if m else None


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    """One record without its last line end; fields with an empty value are left out."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n"


def parse_warc(data: bytes):
    """(fields, block) of each record, by the declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ArchiveError("no record where one must be")
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ArchiveError("a header without an end")
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ArchiveError("a record is shorter than it declares")
        yield fields, block
        at = end + 8 + size


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ArchiveError("a compressed archive is cut off")
        data = member.unused_data
    return b"".join(out) if out else data


def digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


FORM = "page_id long, url string, date string, type string, head binary, payload binary, digest string, size long, error string"


def _converted(data: bytes):
    """The fields of FORM for each content record of an ARC archive."""
    for fields, content in parse_arc(data):
        scheme = fields["URL"].partition(":")[0]
        if scheme == "filedesc":
            continue
        head, payload = split_http(content)
        page = http_field(head, "X-Page-Id")
        yield (int(page) if page else None, fields["URL"], iso_date(fields["Archive-date"]), "resource" if scheme == "dns" else "response", head, payload, digest(payload), len(payload))


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("type", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("size", pa.int64()), ("error", pa.string())])


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive) ARC archives of pages, of about SHARD_BYTES each; versions 1 and 2 take turns."""
    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_runs(batch, 2, SHARD_BYTES):
                version, name = 1 + k % 2, f"legacy-{task:06d}-{k:06d}.arc"
                k += 1
                out = [arc_header(version, name)]
                offset = len(out[0])
                for page, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), pc.fill_null(part.column(2), "").cast(pa.binary()).to_pylist()):
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n"
                    out.append(arc_record(version, name, offset, url or "", head.encode() + html))
                    offset += len(out[-1])
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["archive"])

    return chosen.mapInArrow(tidy(run), "archive binary")


def _needed(rows: list[dict]) -> None:
    """Drop the payloads that need not be stored, because one of the same archive with a smaller page_id is equal."""
    least: dict[str, int] = {}
    for r in rows:
        if r["page_id"] is not None and (r["digest"] not in least or r["page_id"] < least[r["digest"]]):
            least[r["digest"]] = r["page_id"]
    for r in rows:
        if r["size"] >= LEAST_BYTES and r["digest"] in least and r["page_id"] != least[r["digest"]]:
            r["payload"] = None


def read_arc(archives: DataFrame, column: str = "archive", pack: bool = False) -> DataFrame:
    """The content records of ARC archives, with ``pack`` compressed and without payloads that are sure to be revisits.

    An archive that breaks the format gives the records before the break, and then a row that holds the error alone.
    """

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress if pack else bytes
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                try:
                    for row in _converted(data or b""):
                        rows.append(dict(zip(_ARROW.names, row)))
                    if pack:
                        _needed(rows)
                except ArchiveError as broken:
                    rows.append({"error": str(broken)})
                for r in rows:
                    if r.get("payload") is not None:
                        r["payload"] = press(r["payload"])
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return archives.select(column).mapInArrow(tidy(run), FORM)


def with_revisits(records: DataFrame) -> DataFrame:
    """Records with refers_to: the smallest page_id with an equal payload of LEAST_BYTES or more, null for that page itself.

    Rows that share the smallest page_id are all stored. A null page_id never is referred to; if a payload has no
    other, all its records are stored.
    """
    counts = records.where(F.col("size") >= LEAST_BYTES).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = cut(counts)
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(first.where(F.col("n") * PARTS > total).select(F.col("d").alias("hot")))  # fewer than PARTS digests can be
    part = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("page_id"), F.lit(PARTS))).otherwise(0)
    parts = F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = records.join(hot, F.col("digest") == F.col("hot"), "left").withColumn("part", part).drop("hot")
    right = first.join(hot, F.col("d") == F.col("hot"), "left").select("d", "first", F.explode(parts).alias("p"))
    joined = left.join(right, (F.col("digest") == F.col("d")) & (F.col("part") == F.col("p")), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(other, F.col("first"))).drop("d", "first", "part", "p")


def write_warc(records: DataFrame, path: str, packed: bool = False) -> None:
    """Gzipped WARC archives of FILE_STRETCHES stretches of records at most, under path; records with refers_to become revisits."""

    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress if packed else bytes
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                page, url, date, kind, head, payload, sha, size, to = row
                name = uuid.uuid5(NAMESPACE, f"{page}|{url}|{date}|{sha}")
                fields = {"WARC-Type": "revisit" if to is not None else kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{sha}"}
                block = head if to is not None else head + unpress(payload)
                if to is not None:
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(to)}
                fields |= {"Content-Type": "application/http;msgtype=response" if head else "application/octet-stream", "X-Page-Id": "" if page is None else str(page), "X-Payload-Length": str(size), "WARC-Block-Digest": f"sha256:{digest(block)}"}
                out.append(warc_record(fields, block))
                held += len(out[-1])
                if held >= SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(out)], pa.binary())], names=["records"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(out)], pa.binary())], names=["records"])

    names = [n for n in _ARROW.names if n != "error"]
    chosen = records.where("error is null").select(*names, "refers_to").mapInArrow(tidy(run), "records binary")
    chosen.select(F.col("records").cast("string").alias("value")).write.options(lineSep="\r\n", maxRecordsPerFile=FILE_STRETCHES, compression="gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id) of archives; stored digests are checked."""

    def run(batches):
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse_warc(gunzip(data)):
                    sha, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    size = int(fields["X-Payload-Length"])
                    if kind != "revisit":
                        payload = split_http(block)[1]
                        if digest(payload) != sha or len(payload) != size:
                            raise ArchiveError("a payload is not what its record says")
                    page, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, size, sha, kind, int(to) if to else None, fields.get("WARC-Target-URI"), fields["WARC-Record-ID"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Pages as ARC, converted to WARC with revisits, written below path, and read back.

    A null html is an empty payload, a null URL the scheme ``unknown:``. Repeated rows give a record each, and ties of
    the smallest page_id are all responses. Null ids stay. A very long page is a stretch of its own. An empty table
    gives no rows. An archive that cannot be read back ends the job with its error.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    records = read_arc(pages_to_arc(pages), pack=True)
    sound = records.withColumn("digest", F.when(F.col("error").isNull(), F.col("digest")).otherwise(F.raise_error(F.col("error"))))
    write_warc(with_revisits(sound), path, packed=True)
    if spark.read.format("binaryFile").load(path).select("path").isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")
    return read_warc(spark, path)


ORACLE = f"""
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(coalesce(html, '')) >= {LEAST_BYTES} AND page_id IS DISTINCT FROM min(page_id) OVER w AND min(page_id) OVER w IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(coalesce(html, '')) >= {LEAST_BYTES} AND page_id IS DISTINCT FROM min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))"""
