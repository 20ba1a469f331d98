import duckdb
import pandas as pd
import pytest

from blockwright.llm import warc

ROWS = [(3, "http://a b/\n", None), (2, None, ""), (5, "u", "x" * 100), (4, "u2", "x" * 100), (9, "u", "é" * 60), (8, "u", "é" * 60), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 9), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 9), (1, "s", "x" * 99), (0, "s", "x" * 99), (5, "u", "x" * 100)]


def test_pages_equal_sql(spark):
    pages = pd.DataFrame(ROWS, columns=["page_id", "url", "html"])
    told = lambda rows: sorted(tuple("~" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = warc.archive_pages(spark.createDataFrame(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert told(got) == told(duckdb.query(warc.ORACLE).fetchall())
    assert warc.archive_pages(spark.createDataFrame(pages).limit(0)).count() == 0


def test_clashing_columns_change_nothing(spark):
    pages = spark.createDataFrame(pd.DataFrame(ROWS, columns=["page_id", "url", "html"]))
    more = pages.selectExpr("*", "1 AS id", "'x' AS digest", "2 AS size", "'y' AS payload_digest", "'z' AS part", "3 AS record_type")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, warc.archive_pages(more).select(*names).collect())) == sorted(map(str, warc.archive_pages(pages).select(*names).collect()))


@pytest.mark.parametrize("version", [1, 2])
def test_versions(version):
    data = warc.arc_header(version, "n.arc") + warc.arc_record(version, "n.arc", 0, "http://h/ü x", b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nbody\n\n") + warc.arc_record(version, "n.arc", 9, "dns:h", b"20000101000000\nh. 1 IN A 1.2.3.4\n")
    got = list(warc._converted(data))
    assert [(r[0], r[3], r[5]) for r in got] == [(7, "response", b"body\n\n"), (None, "resource", b"20000101000000\nh. 1 IN A 1.2.3.4\n")]
    assert got[0][2] == "2000-01-01T00:00:00Z"


def test_broken_archives():
    good = warc.arc_header(1, "n") + warc.arc_record(1, "n", 0, "http://h/", b"abc")
    for bad in (good[:-3], b"filedesc://x 0 0 0 9\n9 0 x\n", b"no length\n", good + b"http://h/ only three 1\na\n"):
        with pytest.raises(warc.ArchiveError):
            list(warc.parse_arc(bad))


def test_record_round_trip():
    raw = warc.warc_record({"WARC-Type": "response", "Empty": ""}, b"a\r\n\r\nb") + b"\r\n"
    assert list(warc.parse_warc(raw * 2)) == [({"WARC-Type": "response", "Content-Length": "6"}, b"a\r\n\r\nb")] * 2
