import duckdb
import pandas as pd

from blockwright.llm import urls
from blockwright.llm.components import connected_components

ROWS = [
    (1, "http://a.example.net/x", '<link rel="canonical" href="http://b.example.edu/x">'), (2, "http://b.example.edu/x#f", "x"), (3, "http://c.example.edu/", '<meta http-equiv="refresh" content="0; url=http://b.example.edu/x">'),
    (4, "HTTP://Q.Example.NET/en/1", "<LINK href=http://b.example.edu/x REL=canonical>"), (5, None, None), (6, "nope", ""), (7, "http://z.edu", "x"), (7, "http://z.edu", "x"), (8, "http://d.edu/a", '<link rel=canonical href="/b">'),
    (9, "http://d.edu/b?q=/", ""), (10, "net://net", ""), (11, "x://net/", ""), (12, "x://my.example.com/de/1?u", ""), (13, "x://notnet/", ""), (14, "x://a.org/fr/", ""),
]


def test_equals_sql(spark):
    pages = pd.DataFrame(ROWS, columns=["page_id", "url", "html"])
    got = sorted(tuple(map(str, r)) for r in urls.judge(spark.createDataFrame(pages)).collect())
    want = sorted(tuple(map(str, r)) for r in duckdb.query(urls.oracle()).fetchall())
    assert got == want
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[str(k)] for k in (1, 2, 3, 4, 5, 7, 12, 14)] == ["block", "block", "block", "allow", "allow", "allow", "block", "allow"]


LINKED = [
    ("""<meta http-equiv="refresh" content="0; url='http://bad.net/a'">""", "http://bad.net/a"), ("""<meta content='5;URL="http://bad.net/a"' http-equiv=refresh>""", "http://bad.net/a"), ("<meta http-equiv=refresh content=0;url=http://bad.net/a>", "http://bad.net/a"),
    ('<link rel="canonical" href="//bad.net/b">', "http://bad.net/b"), ('<link href="http://bad.net/?a=1&amp;b=2" rel="canonical">', "http://bad.net/?a=1&b=2"), ("<link rel=canonical href=HTTP://BAD.NET/S>", "http://bad.net/S"),
    ('<link rel="canonical" href="other">', "http://ok.edu/dir/other"), ('<link rel="canonical" href="../up/./x?q#f">', "http://ok.edu/up/x?q"), ('<link rel="canonical" href="/a/b/../c/..">', "http://ok.edu/a/"), ('<link rel="canonical" href="?p=2">', "http://ok.edu/dir/page?p=2"),
    ('<link rel="canonical" href="mailto:a@b.net">', None), ('<link rel="canonical" href="">', None), ('<meta http-equiv="refresh" content="30">', None), ('<link rel="stylesheet" href="http://bad.net/c">', None),
]


def test_addresses_of_links(spark):
    pages = spark.createDataFrame([(f"http://OK.edu/dir/page?k{k}#y", source) for k, (source, _) in enumerate(LINKED)], "url string, html string")
    got = {r["src"]: r["dst"] for r in urls.link_edges(pages).collect()}
    assert got == {f"http://ok.edu/dir/page?k{k}": want for k, (_, want) in enumerate(LINKED) if want}


def test_linked_pages_equal_sql(spark):
    """Each kind of link leads to a page that is blocked, by its host or through one more link."""
    rows = [(k, f"http://s{k}.edu/dir/page?x", source) for k, (source, _) in enumerate(LINKED)]
    rows += [(100 + 10 * k + j, f"http://s{k}.edu{path}", '<link rel=canonical href="http://bad.net/z">') for k in range(len(LINKED)) for j, path in enumerate(("/dir/other", "/up/x?q", "/a/", "/dir/page?p=2"))]
    pages = pd.DataFrame([(*r, "clash", "clash") for r in rows], columns=["page_id", "url", "html", "host", "node"])
    got = {r["id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages)).collect()}
    assert [got[k] for k in range(len(LINKED))] == ["block" if want else "allow" for _, want in LINKED]
    pages = pages.drop(columns=["host", "node"])
    assert got == {r[0]: r[4] for r in duckdb.query(urls.oracle()).fetchall()}


def test_given_redirects_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://s.edu/1", None), (2, "http://t.net/2", None)], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://s.edu/1", "http://t.net/2"), (None, "x://y"), ("http://s.edu/1", "http://t.net/2")], "src string, dst string")
    assert {r["id"]: r["verdict"] for r in urls.judge(pages, redirects=moved).collect()} == {1: "block", 2: "block"}
    assert urls.judge(pages.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(5, 5), (None, 3), (300, 301), (301, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert all(got[k] == 0 for k in range(41)) and all(got[200 + k] == 100 for k in range(50)) and got[301] == 300 and len(got) == 41 + 51 + 2
