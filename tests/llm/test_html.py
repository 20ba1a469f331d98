import random
import time

import pytest

from blockwright.llm import html

SCHEMA = "page_id long, url string, html string"


def one(spark, source, url="http://one.example/"):
    return html.extract(spark.createDataFrame([(1, url, source)], SCHEMA)).collect()[0]["text"]


def test_marked_parts_go(spark):
    page = """<!DOCTYPE html><head><title>T</title><script>var a="</p><p>no";</script></head><body><header>Top</header><nav><a>Menu</a></nav><div class="cookie-notice">Cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>,&nbsp;two<br>three<p>Four &#233;<aside>Side</aside><form>Ask</form><div class="ad">Buy</div></article>
    <section id="comments"><p>Reader</p></section><footer>Foot</footer></body>"""
    assert one(spark, page) == "Head & line One bold, two three Four é"


def test_names_of_the_page_around_mark_nothing(spark):
    assert one(spark, '<div class="content no-sidebar has-nav"><p>Kept</p></div><div class="left sidebar">Gone</div>') == "Kept"


def test_hard_sources(spark):
    for source, want in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<div><div><div>deep", "deep"), ("<p>x</i></div></p>y", "x y"), ("<!-- open", ""), ("a < b", "a < b"), ("<article></article>out", ""), ("<script>x", "")):
        assert one(spark, source) == want, source
    assert one(spark, "<div>" * 3000 + "x" + "</div>" * 3000) == "x"


def test_constant_nodes_are_template_and_slots_are_content(spark):
    pages = [(k, f"http://h.example/{k}", f"<div><div>Site name</div><ul><li>Home<li>About</ul></div><div><h1>Title {k}</h1><p>Body {k * k}</p></div><div>Made by us</div>") for k in range(9)]
    rows = html.extract(spark.createDataFrame(pages, SCHEMA)).collect()
    assert sorted(r["text"] for r in rows) == sorted(f"Title {k} Body {k * k}" for k in range(9)) and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_repeated_articles_stay(spark):
    pages = [(k, "http://h.example/", "<nav>x</nav><article><p>Same everywhere</p></article>") for k in range(5)] + [(None, None, "<p>no host</p>")]
    assert sorted(r["text"] for r in html.extract(spark.createDataFrame(pages, SCHEMA)).collect()) == ["Same everywhere"] * 5 + ["no host"]
    assert html.extract(spark.createDataFrame(pages, SCHEMA).limit(0)).count() == 0


def test_alignment_is_the_largest():
    a = html.rebuild([(0, "r", 0), (1, "x", 1), (1, "y", 2), (2, "z", 3), (1, "x", 4)])
    b = html.rebuild([(0, "r", 0), (1, "y", 2), (2, "z", 3), (2, "z", 9), (1, "x", 4)])
    assert {(p.index, q.index) for p, q in html.align(a, b)} in ({(0, 0), (2, 1), (3, 2), (4, 4)}, {(0, 0), (2, 1), (3, 3), (4, 4)})


def test_slots_decide_on_pages_with_an_article(spark):
    pages = [(k, f"http://h.example/{k}", f"<div>Site name</div><h1>Title {k}</h1><article><p>Lead {k}</p><p>Read all we print</p></article><div>Body {k * k}</div>") for k in range(9)]
    assert sorted(r["text"] for r in html.extract(spark.createDataFrame(pages, SCHEMA)).collect()) == sorted(f"Title {k} Lead {k} Read all we print Body {k * k}" for k in range(9))


def test_repeated_lines_of_articles_stay(spark):
    """Whatever stands in an article, and running text between slots of one parent; constant blocks elsewhere go."""
    articles = [(k, f"http://a.example/{k}", f"<div>Site</div><article><h1>T{k}</h1><h2>Introduction</h2><p>Body {k} words.</p><p>All figures are in euros.</p></article><div>Made by us</div>") for k in range(6)]
    plain = [(10 + k, f"http://b.example/{k}", f"<p>Site</p><div><h1>T{k}</h1><h2>Introduction</h2><p>Body {k}</p><div>Menu</div><p>More {k}</p></div><p>Made by us</p>") for k in range(6)]
    rows = {r["id"]: r["text"] for r in html.extract(spark.createDataFrame(articles + plain, SCHEMA)).collect()}
    assert rows == {k: f"T{k} Introduction Body {k} words. All figures are in euros." for k in range(6)} | {10 + k: f"T{k} Introduction Body {k} More {k}" for k in range(6)}


@pytest.mark.parametrize("name,gone", [("hidden-gem", False), ("side-note", False), ("share-price", False), ("reader-responses", True), ("comment-list", True), ("site-footer", True), ("cookieNotice", True), ("ad", True), ("ad-slot-2", True), ("adventure", False), ("related_posts", True)])
def test_names_are_judged_whole(name, gone):
    root = html.parse(f'<p>a <span class="{name}">b</span> c</p><div id="{name}">d</div>')
    assert html.main_text(root, None) == ("a c" if gone else "a b c d")


def test_long_pages_are_aligned_in_proportion():
    """A megabyte of sections of many kinds on either side."""
    rng = random.Random(2)

    def page(n):
        rows = [(0, "r", 0)]
        for k in range(n):
            rows.append((1, "section", 0))
            rows += [(d, rng.choice(["p", "ul", "h2", "div"]), k) for d in [2, *(rng.choice([2, 2, 3]) for _ in range(rng.randrange(2, 9)))]]
        return html.rebuild(rows)

    began = time.process_time()
    pairs = html.align(page(5000), page(4700))
    assert len(pairs) > 4700 and time.process_time() - began < 40
    assert len({a.index for a, _ in pairs}) == len({b.index for _, b in pairs}) == len(pairs)


def test_template_past_the_cut_and_off_the_exemplar(spark):
    deep = "<div>" * 20 + "<p>Made by us</p>" + "</div>" * 20
    wide = "".join(f"<p>Line {{k}}-{n}</p>" for n in range(70)) + "<h4>Read all we print</h4>"
    pages = [(0, "http://h.example/0", "<b>Not found</b>")] + [(k, f"http://h.example/{k}", f"<h1>Title {k}</h1>{deep}{wide.replace('{k}', str(k))}") for k in range(1, 9)]
    rows = {r["id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert rows == {0: "Not found"} | {k: " ".join([f"Title {k}", *(f"Line {k}-{n}" for n in range(70))]) for k in range(1, 9)}


def weight(a, b):
    """Simple tree matching as the textbook has it."""
    if a.tag != b.tag:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weight(x, y))
    return table[-1][-1] + 1


@pytest.mark.parametrize("cells", [1 << 20, 2])
def test_alignment_equals_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html, "CELLS", cells)
    rng = random.Random(6)
    for _ in range(300):
        trees = []
        for _ in range(2):
            rows, depth = [(0, "r", 0)], 0
            for k in range(rng.randint(0, 14)):
                depth = rng.randint(1, depth + 1)
                rows.append((depth, rng.choice("ab"), k))
            trees.append(html.rebuild(rows))
        pairs = html.align(*trees)
        assert len(pairs) == weight(*trees)
        parents = [{c.index: n.index for n in tree(t) for c in n.children} for t in trees]
        found = {a.index: b.index for a, b in pairs}
        assert len(found) == len(pairs) == len(set(found.values()))
        for a, b in pairs:
            assert a.tag == b.tag and (a.index == 0) == (b.index == 0)
            assert a.index == 0 or found[parents[0][a.index]] == parents[1][b.index]
        order = sorted(found)
        assert [found[k] for k in order] == sorted(found.values())


@pytest.mark.parametrize("most", [1 << 10, 0])
def test_long_lists_are_matched_whole(monkeypatch, most):
    """Sections of many kinds: the matching is the largest and the same, whether weights are worked out one by one or together."""
    rng = random.Random(9)

    def page(n):
        rows = [(0, "r", 0)]
        for k in range(n):
            rows += [(1, rng.choice(["s", "s", "t"]), k), *((d, rng.choice("abc"), k) for d in [2, *(rng.choice([2, 2, 3, 3]) for _ in range(rng.randrange(0, 12)))])]
        return html.rebuild(rows)

    pairs = [(page(60), page(55)) for _ in range(2)] + [(page(5), page(7)) for _ in range(20)]
    plain = []
    for a, b in pairs:
        monkeypatch.setattr(html, "KIND_PAIRS", 1 << 30)
        plain.append([(x.index, y.index) for x, y in html.align(a, b)])
        assert len(plain[-1]) == weight(a, b)
    monkeypatch.setattr(html, "KIND_PAIRS", most)
    for cells in (1 << 20, 7):
        monkeypatch.setattr(html, "CELLS", cells)
        for (a, b), want in zip(pairs, plain):
            got = [(x.index, y.index) for x, y in html.align(a, b)]
            assert len(got) == len(want) and (cells == 7 or got == want)


def tree(t):
    yield t
    for c in t.children:
        yield from tree(c)


def test_wide_and_deep_trees_are_aligned_whole():
    wide = [(0, "r", 0)] + [(1, "ab"[k % 3 == 0], k) for k in range(3000)]
    other = [(0, "r", 0)] + [(1, "ab"[k % 5 == 0], k) for k in range(2500)]
    began = time.time()
    assert len(html.align(html.rebuild(wide), html.rebuild(other))) > 2000
    deep = html.rebuild([(k, "d", k) for k in range(4000)])
    assert len(html.align(deep, html.rebuild([(k, "d", k) for k in range(3500)]))) == 3500
    assert time.time() - began < 20


def test_names_of_states_and_articles_mark_nothing(spark):
    assert one(spark, '<article class="post comments-open"><p>Body</p></article>') == "Body"
    assert one(spark, '<div class="search-results"><p>Found</p></div><div class="search-box">Ask</div>') == "Found"


def test_parsing_takes_linear_time():
    def took(n):
        source = "<div>" * n + "</p></i>text" * n + "<li>x" * n
        began = time.process_time()
        html.parse(source)
        return time.process_time() - began

    took(500)
    assert took(16000) < 30 * max(0.01, took(2000))


def test_copies_of_a_page_vote_once(spark):
    copies = [(k, "http://h.example/", "<h1>One</h1><p>Same text</p>") for k in range(8)]
    others = [(10 + k, "http://h.example/", f"<h1>Title {k}</h1><p>Body {k}</p>") for k in range(2)]
    rows = html.extract(spark.createDataFrame(copies + others, SCHEMA)).collect()
    assert sorted(r["text"] for r in rows) == ["One Same text"] * 8 + ["Title 0 Body 0", "Title 1 Body 1"]


def test_hot_hosts_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(html, "PARTS", 4)
    pages = [(k, f"http://{'hot' if k % 3 else f'h{k % 9}'}.example/{k}", f"<div>Site</div><p>Body {k}</p>") for k in range(120)] + [(None, "http://hot.example/", "<div>Site</div><p>No id</p>")]
    rows = html.extract(spark.createDataFrame(pages, SCHEMA).withColumn("host", html.F.lit("x")).withColumn("part", html.F.lit(1))).collect()
    assert sorted(r["text"] for r in rows) == sorted([f"Body {k}" for k in range(120)] + ["No id"])


def test_query_equals_articles_cut_out_by_hand(spark):
    """The given pages hold one article each, of headings, paragraphs, bold words and line breaks."""
    import html as entities
    import re

    from blockwright.llm import queries

    def by_hand(source):
        inside = re.search(r"<article>(.*?)</article>", source or "", re.S)
        blocks = re.split(r"</?(?:p|h\d|li|ul|div)\b[^>]*>", inside[1]) if inside else []
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", b))).split()) for b in blocks]
        return " ".join(x for x in lines if x)

    pages = {r["page_id"]: by_hand(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op8_html"](spark, "/root/testdata/sf0.001").collect()}
    assert got == pages and sum(map(bool, pages.values())) > 20


def test_pages_of_one_form_are_aligned_once(monkeypatch):
    """Alignments follow from tags and depths alone; what is remembered is bounded and the same as what is worked out anew."""
    rng = random.Random(8)
    pages = ["<div>" + "".join(f"<{t}>w{rng.random()}</{t}>" for t in rng.choice(("pph", "php", "hpph"))) + "</div>" for _ in range(40)]
    shapes = [html.shape_of(html.parse(p))[0] for p in pages]
    whole, calls = html.align, []
    monkeypatch.setattr(html, "align", lambda a, b: calls.append(1) or whole(a, b))
    for most, held in ((html.REMEMBERED, 3), (1, 1)):
        monkeypatch.setattr(html, "REMEMBERED", most)
        calls.clear()
        aligner = html.Aligner()
        wrapper = aligner.wrapper("h", lambda: html.Wrapper(html.pack_shape(shapes[0]), [1]))
        for rows in shapes:
            depths, tags, _ = zip(*rows)
            want = {(a.index, b.index) for a, b in whole(html.rebuild(shapes[0]), html.rebuild(rows))}
            assert set(zip(*(x.tolist() for x in aligner.places(wrapper, depths, tags)))) == want
        assert len(aligner.known.held) == held and (held == 1 or len(calls) == held)


def test_lines_are_told_once(monkeypatch):
    """One decoding of each run of text, whatever is asked of a page."""
    root = html.parse("<div>a &amp; b<p>c\x1f 　d</p>e<nav>f</nav></div>")
    calls, decode = [], html.entities.unescape
    monkeypatch.setattr(html.entities, "unescape", lambda x: calls.append(x) or decode(x))
    html.shape_of(root), html.path_texts(root)
    assert html.main_text(root, None) == html.main_text(root, set()) == "a & b c d e"
    assert len(calls) == 4
