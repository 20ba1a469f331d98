"""HTML extraction by wrapper induction.

Each page is parsed into a tree of blocks. Pages of one host are aligned with that host's exemplar page by simple
tree matching over whole trees; a node whose text is the same wherever it was aligned is the host's template, a node
whose text varies is a slot. Votes are counted over different pages (copies of a page vote once) with partial
aggregation, so a host that owns a third of all pages costs no more than its template has nodes. Texts that stay the
same at their path of tags over all pages of a host are template too, also on pages unlike the exemplar. A second
alignment then takes each page's slots. What HTML itself marks as no content (menus, headers and footers of the page,
forms, scripts, adverts and the like) is left out wherever it stands. The slots tell the content region: running text
that is the same on all pages but stands between two slots of one parent belongs to it. An article or main element is
content whole, however often its lines are repeated, and without a template of its host nothing else is.
"""

from __future__ import annotations

import html as entities
import json
import re
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_runs, tidy
from .urls import url_host

RUN_BYTES = 4 << 20
#: Aligned pages that a template node needs, and the share of them that must agree.
LEAST_PAGES, AGREE = 3, 0.9
#: Cells of a matching's table that are held at once; larger tables are divided.
CELLS = 1 << 20
#: Nodes, and keys of lasting texts, that a task remembers of hosts and of alignments; it starts anew beyond.
REMEMBERED = 1 << 18
#: Characters of a tag whose marks are remembered, and how many such tags are.
TAG_CHARS, TAGS = 256, 1 << 12
#: Hosts with more than one of so many of the pages are hot: their pages are dealt into so many parts when they meet the host's wrapper.
PARTS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select button".split())
DROP = frozenset("head nav header footer aside form menu dialog script style noscript template textarea title iframe svg math object canvas select button label fieldset".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset(("article", "main"))
#: Parts of class and id names that mark what is no content, and parts that say only where or how a marked thing stands.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "comment comments commentlist disqus respond response responses reply replies discussion sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar share sharing social "
    "related recommend recommended recommendations search searchform login signin complementary contentinfo alert alerts skip hidden copyright".split()
)
PLACED = frozenset(
    "a area bar bars block blocks bottom box boxes button buttons col column columns container content fixed form global group header home horizontal icon icons inner item items left link links list lists main message messages mobile module outer "
    "page panel post posts primary reader readers region right row secondary section sections site slot small sticky top unit user users vertical wrap wrapper 0 1 2 3 4 5 6 7 8 9".split()
)
#: Names that say something of the page around a part, as in no-sidebar, comments-open or search-results.
ABOUT = re.compile(r"(?:no|not|has|with|without|is)[-_]|.*[-_](?:open|opened|closed|enabled|disabled|on|off|active|visible|results?|page|content|body|main|template)$", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|</?([A-Za-z][^\s>/]*)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)


class Node:
    __slots__ = ("tag", "bad", "main", "children", "texts", "told")

    def __init__(self, tag: str, bad: bool = False, main: bool = False):
        self.tag, self.bad, self.main = tag, bad, main
        self.children: list[Node] = []
        self.texts: list = []  # runs of text and child blocks, in page order
        self.told: list | None = None  # its lines and child blocks, once asked for


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag)}


def _marked(tag: str, raw: str) -> bool:
    if tag in DROP:
        return True
    if "=" not in raw and "hidden" not in raw:
        return False
    a = _attributes(raw[len(tag) + 1 :].rstrip("/>"))
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert", "alertdialog"):
        return True
    if tag in MAIN:  # an article is one whatever it is called
        return False
    return any(_names_a_mark(name) for k in ("class", "id") for name in a.get(k, "").split())


_marked_again = lru_cache(TAGS)(_marked)


def _names_a_mark(name: str) -> bool:
    """Whether a class or id names a marked thing: one of its parts does, and no other part names anything else (as in hidden-gem or side-note)."""
    parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
    parts = [p.lower() for p in parts]
    return any(p in MARKED for p in parts) and all(p in MARKED or p in PLACED for p in parts) and not ABOUT.match(name)


def parse(source: str) -> Node:
    """A tree of blocks; tags that stand inside a line of text are part of it. Time and space grow with the source's length."""
    root = Node("#root")
    stack, at = [root], 0
    open_: dict[str, int] = {}  # how many nodes of the stack have a tag

    def shut(k: int) -> None:
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    end = len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if not m:
            stack[-1].texts.append(source[at:])
            break
        start, after = m.span()
        if start > at:
            stack[-1].texts.append(source[at:start])
        at, raw, name = after, m[0], m[1]
        if name is None:
            continue
        name = name.lower()
        if raw[1] == "/":
            if open_.get(name, 0) > 0:
                if name in INLINE:
                    if name not in VOID:
                        while stack[-1].tag in INLINE and stack[-1].tag != name:
                            shut(len(stack) - 1)
                        if stack[-1].tag == name:
                            shut(len(stack) - 1)
                    continue
                shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name))
            continue
        if name in RAW and not raw.endswith("/>"):  # all up to the end tag is no markup
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if name in VOID:
            stack[-1].texts.append(" ")
            continue
        bad = (_marked_again if len(raw) <= TAG_CHARS else _marked)(name, raw)
        if name in INLINE and not bad:
            continue
        if name in CLOSES_P and open_.get("p", 0) > 0:  # a paragraph that is still open ends here, as do the inline blocks in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    shut(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and open_.get(name, 0) > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    shut(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "tr") and not (name == "tr" and stack[k].tag == "tr"):
                    break
        node = Node(name, stack[-1].bad or (bad and name not in ("html", "body")), stack[-1].main or name in MAIN)
        # The heading of an article belongs to it.
        if name == "header" and stack[-1].main and not stack[-1].bad:
            node.bad = False
        stack[-1].children.append(node)
        stack[-1].texts.append(node)
        if not raw.endswith("/>"):
            stack.append(node)
            open_[name] = open_.get(name, 0) + 1
    return root


def told(node: Node) -> list:
    """The node's own lines, references decoded and white space made one space, and its child blocks, in page order."""
    if node.told is None:
        node.told, run = [], []
        for x in [*node.texts, None]:
            if isinstance(x, str):
                run.append(x)
                continue
            if run and (line := " ".join(entities.unescape("".join(run)).split())):
                node.told.append(line)
            run = []
            if x is not None:
                node.told.append(x)
    return node.told


def own_text(node: Node) -> list[str]:
    """The node's own lines between its child blocks."""
    return [x for x in told(node) if isinstance(x, str)]


def flatten(root: Node) -> list[tuple[int, Node]]:
    """(depth, node) in page order."""
    out, todo = [], [(0, root)]
    while todo:
        depth, node = todo.pop()
        out.append((depth, node))
        todo += [(depth + 1, c) for c in reversed(node.children)]
    return out


def path_texts(root: Node) -> list[tuple[int, int, Node]]:
    """(path, text, node) of every unmarked node with own text: hashes of the tags down to it, and of those with its text."""
    from xxhash import xxh64_intdigest

    out, todo = [], [(0, root)]
    while todo:
        above, node = todo.pop()
        path = xxh64_intdigest(node.tag, above)
        if not node.bad and (lines := own_text(node)):
            out.append((path, xxh64_intdigest("\n".join(lines), path), node))
        todo += [(path, c) for c in node.children]
    return out


class Shape:
    """A node of a tree's lasting form: its number in page order, tag and digest of its own text (0: none), size of its tree, and a hash of that tree's tags."""

    __slots__ = ("index", "tag", "digest", "children", "size", "form")

    def __init__(self, index: int, tag: str, digest: int):
        self.index, self.tag, self.digest, self.children, self.size, self.form = index, tag, digest, [], 1, 0


def shape_of(root: Node) -> tuple[list[tuple[int, str, int]], list[Node]]:
    """(depth, tag, digest) and the nodes themselves, in page order."""
    rows, nodes = [], []
    for depth, node in flatten(root):
        lines = own_text(node)
        digest = int.from_bytes(blake2b("\n".join(lines).encode(), digest_size=8).digest(), "big") if lines else 0
        rows.append((depth, node.tag, digest))
        nodes.append(node)
    return rows, nodes


def pack_shape(rows: list[tuple[int, str, int]]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(json.dumps(list(zip(*rows)), separators=(",", ":")).encode())


def unpack_rows(packed: bytes) -> tuple[list[int], list[str], list[int]]:
    """Depths, tags and digests of a shape's nodes."""
    import zstandard

    return tuple(json.loads(zstandard.ZstdDecompressor().decompress(packed)))


def rebuild(rows) -> Shape:
    from xxhash import xxh64_intdigest

    path: list[Shape] = []
    made: list[Shape] = []
    for index, (depth, tag, digest) in enumerate(rows):
        node = Shape(index, tag, digest)
        made.append(node)
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    for node in reversed(made):  # children before their parents
        node.size += sum(c.size for c in node.children)
        node.form = xxh64_intdigest(node.tag + "".join(f" {c.form:x}" for c in node.children))
    return made[0]


def _middle(a: Shape, b: Shape) -> tuple[int, list[Shape], list[Shape]]:
    """How many children of a and b match from the start because their trees have the same tags, and what is left between such a start and such an end."""
    xs, ys = a.children, b.children
    n = min(len(xs), len(ys))
    start = next((k for k in range(n) if xs[k].form != ys[k].form), n)
    end = next((k for k in range(n - start) if xs[-1 - k].form != ys[-1 - k].form), n - start)
    return start, xs[start : len(xs) - end], ys[start : len(ys) - end]


def _kinds(side: list[Shape]) -> list[Shape]:
    return list({x.form: x for x in side}.values())


def _weights(xs: list[Shape], ys: list[Shape], memo: dict):
    """(matrix, rows, columns): the weight of every pair of kinds of trees, and which kind each tree is."""
    kinds = [{}, {}]
    codes = [np.array([k.setdefault(x.form, (len(k), x))[0] for x in side]) for k, side in zip(kinds, (xs, ys))]
    if len(kinds[0]) * len(kinds[1]) > KIND_PAIRS:
        key = tuple(kinds[0]), tuple(kinds[1])
        if memo.get("latest", (None,))[0] != key:  # one such matrix is kept
            memo["latest"] = key, _all_weights(*([x for _, x in k.values()] for k in kinds))
        return memo["latest"][1], *codes
    table = np.array([[_weight(x, y, memo) for _, y in kinds[1].values()] for _, x in kinds[0].values()], np.int32)
    return table, *codes


#: Pairs of kinds of trees that are weighed one by one; the weights of more are worked out together.
KIND_PAIRS = 1 << 10


def _all_weights(xs: list[Shape], ys: list[Shape]) -> np.ndarray:
    """The same weights for every pair of many kinds: those of their children's kinds first, level by level, then of all pairs of one tag and about one number of children in step."""
    levels = [(xs, ys)]
    while all(below := [_kinds([c for x in side for c in x.children]) for side in levels[-1]]):
        levels.append(tuple(below))
    table = np.zeros((1, 1), np.int32)  # the last row and column stand for no child
    codes: list[dict] = [{}, {}]
    for sides in reversed(levels):
        out = np.zeros((len(sides[0]) + 1, len(sides[1]) + 1), np.int32)
        groups = [_by_tag(side, code, len(code)) for side, code in zip(sides, codes)]
        for tag, left in groups[0].items():
            for rows, a in left:
                for columns, b in groups[1].get(tag, ()):
                    step = max(1, CELLS // (len(columns) * (b.shape[1] + 1)))
                    for r in range(0, len(rows), step):
                        out[np.ix_(rows[r : r + step], columns)] = 1 + _best_together(table, a[r : r + step], b)
        table, codes = out, [{x.form: k for k, x in enumerate(side)} for side in sides]
    return table[:-1, :-1]


def _by_tag(side: list[Shape], code: dict, none: int) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """(places, children's kinds) of trees of one tag whose lists of children have about one length; shorter ones are filled up with ``none``."""
    found: dict = {}
    for k, x in enumerate(side):
        n = len(x.children) if code else 0
        bits = max(0, n.bit_length() - 2)
        found.setdefault((x.tag, -(-n >> bits) << bits), []).append(k)
    out: dict = {}
    for (tag, n), places in found.items():
        rows = np.full((len(places), n), none)
        for r, k in enumerate(places if n else ()):
            own = [code[c.form] for c in side[k].children]
            rows[r, : len(own)] = own
        out.setdefault(tag, []).append((np.array(places), rows))
    return out


def _best_together(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best weights of every row of ``a`` with every row of ``b``, lists of kinds."""
    if a.shape[0] * b.shape[0] < b.shape[1]:  # few long lists
        return np.array([[_last_row(table, x, y)[-1] for y in b] for x in a], np.int32)
    best = [np.zeros((len(a), len(b)), np.int32)] * (b.shape[1] + 1)
    for i in range(a.shape[1]):
        weight, row = table[a[:, i]], [best[0]]
        for j in range(b.shape[1]):
            now = weight[:, b[:, j]]
            now += best[j]
            np.maximum(now, best[j + 1], out=now)
            row.append(np.maximum(now, row[j], out=now))
        best = row
    return best[-1]


def _weight(x: Shape, y: Shape, memo: dict) -> int:
    if x.tag != y.tag:
        return 0
    if x.form == y.form:
        return x.size
    return memo[x.form, y.form] if x.children and y.children else 1


def _last_row(table: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Best weights of all rows with the first 0, 1, ... columns."""
    best = np.zeros(len(columns) + 1, np.int32)
    for r in rows:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + table[r, columns]))
    return best


def _matched(table: np.ndarray, rows: np.ndarray, columns: np.ndarray):
    """(row, column) pairs of a best matching that keeps the order."""
    todo = [(0, len(rows), 0, len(columns))]
    while todo:
        top, bottom, left, right = todo.pop()
        n, m = bottom - top, right - left
        if not n or not m:
            continue
        if n > 1 and n * m > CELLS:  # halve the rows where the best columns for both halves meet
            mid = top + n // 2
            above = _last_row(table, rows[top:mid], columns[left:right])
            below = _last_row(table, rows[mid:bottom][::-1], columns[left:right][::-1])[::-1]
            cut_at = left + int(np.argmax(above + below))
            todo += [(top, mid, left, cut_at), (mid, bottom, cut_at, right)]
            continue
        best = np.zeros((n + 1, m + 1), np.int32)
        for i in range(n):
            best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + table[rows[top + i], columns[left:right]]))
        i, j = n, m
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                yield top + i, left + j


def _lists(a: Shape, b: Shape) -> tuple[list[tuple[Shape, Shape]], list[Shape], list[Shape]]:
    """Children that match because their trees have the same tags, and the lists between them in which matches are sought, whole."""
    start, xs, ys = _middle(a, b)
    after = len(a.children) - start - len(xs)
    same = [*zip(a.children[:start], b.children[:start]), *(zip(a.children[-after:], b.children[-after:]) if after else ())]
    return same, xs, ys


def _weigh(a: Shape, b: Shape, memo: dict) -> None:
    """Puts the weight of a pair of trees, and of all pairs below that it needs, into ``memo``."""
    todo = [(a, b)]
    while todo:
        a, b = todo[-1]
        if (a.form, b.form) in memo or a.form == b.form:
            todo.pop()
            continue
        same, xs, ys = _lists(a, b)
        kinds = (_kinds(xs), _kinds(ys)) if xs and ys else ((), ())
        if len(kinds[0]) * len(kinds[1]) <= KIND_PAIRS:
            open_ = [(x, y) for x in kinds[0] for y in kinds[1] if x.tag == y.tag and x.children and y.children and x.form != y.form and (x.form, y.form) not in memo]
            if open_:
                todo += open_
                continue
        memo[a.form, b.form] = 1 + sum(x.size for x, _ in same) + (int(_last_row(*_weights(xs, ys, memo))[-1]) if xs and ys else 0)
        todo.pop()


def align(wrapper: Shape, page: Shape) -> list[tuple[Shape, Shape]]:
    """The pairs of nodes of a largest matching: order kept, tags equal along with all parents' (simple tree matching).

    Trees with the same tags match whole, and a pair of kinds of trees is weighed once, however often they stand in a
    list. The matching is the largest whatever the lists' lengths: how weights are worked out depends on the number of
    kinds, the weights do not. Time and the one matrix that is kept grow with the pairs of different kinds in a list.
    """
    if wrapper.tag != page.tag:
        return []
    memo: dict = {}
    out, todo = [], [(wrapper, page)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        if a.form != b.form and a.children and b.children and (a.form, b.form) not in memo:
            _weigh(a, b, memo)  # of lists of many kinds, only the pairs that match are weighed below
        same, xs, ys = _lists(a, b)
        todo += same
        if xs and ys:
            table, rows, columns = _weights(xs, ys, memo)
            todo += [(xs[i], ys[j]) for i, j in _matched(table, rows, columns)]
    return out


class Wrapper:
    """What is known of a host: its exemplar's depths, tags and digests, the places of its template, and its lasting texts."""

    __slots__ = ("form", "digests", "template", "lasting", "size")

    def __init__(self, packed: bytes, template=(), lasting=()):
        depths, tags, digests = unpack_rows(packed)
        self.form, self.digests = (tuple(depths), tuple(tags)), np.array(digests, np.uint64)
        self.template = np.zeros(len(digests), bool)
        self.template[list(template)] = True
        self.lasting = frozenset(k % (1 << 64) for k in lasting)
        self.size = len(digests) + len(self.lasting)


class Remembered:
    """Values by key, as many as REMEMBERED allows by their sizes."""

    def __init__(self):
        self.held, self.size = {}, 0

    def get(self, key, make, size):
        value = self.held.get(key)
        if value is None:
            value = make()
            self.size += size(value)
            if self.size > REMEMBERED:
                self.held, self.size = {}, size(value)
            self.held[key] = value
        return value


class Aligner:
    """Alignments of pages with wrappers. They follow from the depths and tags alone, so pages alike in those share one."""

    def __init__(self):
        self.hosts, self.known = Remembered(), Remembered()

    def wrapper(self, host: str, make) -> Wrapper:
        return self.hosts.get(host, make, lambda w: w.size)

    def places(self, wrapper: Wrapper, depths, tags) -> tuple[np.ndarray, np.ndarray]:
        """Places of the aligned nodes in the wrapper and in the page."""
        form = tuple(depths), tuple(tags)

        def make():
            pairs = [(a.index, b.index) for a, b in align(*(rebuild(zip(*f, [0] * len(f[0]))) for f in (wrapper.form, form)))]
            return tuple(np.array(pairs, np.int32).reshape(-1, 2).T)

        return self.known.get((wrapper.form, form), make, lambda v: len(v[0]) + len(form[0]))


#: Blocks of running text; a constant one between two slots of its parent belongs to what they tell.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())


def _enclosed(root: Node, template: set[int]) -> set[int]:
    """Constant blocks of running text between the first and the last child of their parent in which a slot stands."""
    holds: set[int] = set()
    order = [n for _, n in flatten(root)]
    for n in reversed(order):  # children before their parents
        if not n.bad and (id(n) not in template and own_text(n) or any(id(c) in holds for c in n.children)):
            holds.add(id(n))
    out: set[int] = set()
    for n in order:
        slots = [k for k, c in enumerate(n.children) if id(c) in holds]
        if slots:
            out |= {id(c) for c in n.children[slots[0] : slots[-1]] if c.tag in RUNNING and not c.children and not c.bad}
    return out


def main_text(root: Node, template: set[int] | None) -> str:
    """Text of articles whole, of slots, and of running text between slots; with no template known, of an article or main element alone, if there is one."""
    inside = template is None and any(n.main and not n.bad for _, n in flatten(root))
    kept = _enclosed(root, template) if template is not None else set()
    out: list[str] = []

    def walk(start: Node) -> None:
        todo: list = [start]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x.bad:
                continue
            if template is None:
                use = x.main or not inside
            else:
                use = x.main or id(x) not in template or id(x) in kept
            todo += [y for y in reversed(told(x)) if use or not isinstance(y, str)]

    walk(root)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    A null or empty html has the empty text. A page without a host is judged by its own marks alone, as is a host
    with fewer than LEAST_PAGES different pages, among which nothing could be told to be constant. Of equal ids the
    smallest shape is the exemplar. Null ids and repeated rows stay and are extracted alike; an empty table gives no
    rows. Whole pages of any depth and width are aligned.
    """
    types = dict(pages.dtypes)
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))

    def shapes_of(batches):
        for batch in batches:
            for part in text_runs(batch, 2, RUN_BYTES):
                packed, paths = [], []
                for t in part.column(2).to_pylist():
                    root = parse(t)
                    packed.append(pack_shape(shape_of(root)[0]))
                    paths.append(np.array(sorted({(p, k) for p, k, _ in path_texts(root)}), np.uint64).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary()), pa.array(paths, pa.binary())], names=["host", "id", "shape", "paths"])

    def path_votes(batches):
        for batch in batches:
            counts: dict = {}
            for host, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = np.frombuffer(packed, np.int64).reshape(-1, 2)
                for p in set(pairs[:, 0].tolist()):
                    counts[host, p, None] = counts.get((host, p, None), 0) + 1
                for p, k in pairs.tolist():
                    counts[host, p, k] = counts.get((host, p, k), 0) + 1
            hosts, ps, ks = zip(*counts) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ps, pa.int64()), pa.array(ks, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["host", "path", "key", "n"])

    with_host = chosen.where("host <> '' and html is not null and html <> ''").select("host", "id", "html")
    shapes = with_host.mapInArrow(tidy(shapes_of), f"host string, id {types[id_col]}, shape binary, paths binary")
    shapes = cut(shapes.groupBy("host", "shape").agg(F.min("id").alias("id"), F.min("paths").alias("paths"), F.count("*").alias("copies")))
    # A host's exemplar is its page with the smallest id; of several, the one with the smallest shape.
    exemplars = shapes.groupBy("host").agg(F.min(F.struct("id", "shape")).alias("k"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES).select("host", F.col("k.shape").alias("wrapper"))
    sizes = shapes.groupBy("host").agg(F.sum("copies").alias("pages"))
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    hot = F.broadcast(cut(sizes.where(F.col("pages") * PARTS > total).select(F.col("host").alias("hot"))))  # fewer than PARTS hosts can be

    def dealt(rows: DataFrame, part) -> DataFrame:
        """Rows with the part of their host; one that is not hot has one part."""
        return rows.join(hot, F.col("host") == F.col("hot"), "left").withColumn("part", part).drop("hot")

    def meet(rows: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
        """Rows with what is known of their host, hot hosts in parts."""
        left = dealt(rows, F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(0))
        right = dealt(wrappers, F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
        return left.join(right, ["host", "part"], how).drop("part")

    def vote(batches):
        aligner = Aligner()
        for batch in batches:
            counts: dict = {}
            hosts, wrappers = batch.column(0).to_pylist(), batch.column(2)
            for i, packed in enumerate(batch.column(1).to_pylist()):
                wrapper = aligner.wrapper(hosts[i], lambda i=i: Wrapper(wrappers[i].as_py()))
                depths, tags, digests = unpack_rows(packed)
                left, right = aligner.places(wrapper, depths, tags)
                if hosts[i] not in counts:
                    counts[hosts[i]] = wrapper.digests, np.zeros((2, len(wrapper.digests)), np.int64)
                votes = counts[hosts[i]][1]
                votes[0, left] += 1
                votes[1, left] += wrapper.digests[left] == np.array(digests, np.uint64)[right]
            rows = [(host, node, *votes[:, node].tolist()) for host, (digests, votes) in counts.items() for node in np.flatnonzero((digests > 0) & (votes[0] > 0)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((),) * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "node", "aligned", "equal"])

    votes = meet(shapes.select("host", "id", "shape"), exemplars, "inner").select("host", "shape", "wrapper").mapInArrow(tidy(vote), "host string, node int, aligned long, equal long")
    fixed = votes.groupBy("host", "node").agg(F.sum("aligned").alias("aligned"), F.sum("equal").alias("equal")).where((F.col("aligned") >= LEAST_PAGES) & (F.col("equal") >= AGREE * F.col("aligned")))
    templates = fixed.groupBy("host").agg(F.collect_set("node").alias("template"))  # at most the nodes of one exemplar
    standing = cut(shapes.select("host", "paths").mapInArrow(tidy(path_votes), "host string, path long, key long, n long").groupBy("host", "path", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_PAGES))
    bearing = standing.where("key is null").select("host", "path", F.col("n").alias("pages"))
    lasting = standing.where("key is not null").join(bearing, ["host", "path"]).where(F.col("n") >= AGREE * F.col("pages")).groupBy("host").agg(F.collect_set("key").alias("lasting"))
    none = lambda name, kind: F.coalesce(name, F.array().cast(f"array<{kind}>")).alias(name)
    known = cut(
        exemplars.join(templates, "host", "left").join(lasting, "host", "left").where("template is not null or lasting is not null")
        .select("host", "wrapper", none("template", "int"), none("lasting", "bigint"))
    )

    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in text_runs(batch, 3, RUN_BYTES):
                packed = [press(x) for x in pc.fill_null(part.column(3), "").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(packed, pa.binary())], names=["id", "url", "host", "packed"])

    def take(batches):
        import zstandard

        aligner = Aligner()
        unpress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in batch_slices(batch, 256):
                hosts, texts = part.column(2).to_pylist(), []
                wrappers, fixed_of, lasting_of = (part.column(k) for k in (4, 5, 6))
                for i, packed in enumerate(part.column(3).to_pylist()):
                    root, constant = parse(unpress(packed).decode()), None
                    if fixed_of[i].is_valid:
                        wrapper = aligner.wrapper(hosts[i], lambda i=i: Wrapper(wrappers[i].as_py(), fixed_of[i].as_py(), lasting_of[i].as_py()))
                        rows, nodes = shape_of(root)
                        depths, tags, digests = zip(*rows)
                        left, right = aligner.places(wrapper, depths, tags)
                        same = wrapper.template[left] & (wrapper.digests[left] == np.array(digests, np.uint64)[right])
                        constant = {id(nodes[k]) for k in right[same].tolist()}
                        if wrapper.lasting:
                            constant |= {id(node) for _, k, node in path_texts(root) if k in wrapper.lasting}
                    texts.append(main_text(root, constant))
                out = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out, pc.cast(pc.utf8_length(out), pa.int64())], names=["id", "url", "text", "n_chars"])

    def batch_slices(batch, rows: int):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

    moved = chosen.mapInArrow(tidy(pack), f"id {types[id_col]}, url string, host string, packed binary")
    joined = meet(moved, known, "left").select("id", "url", "host", "packed", "wrapper", "template", "lasting")
    return joined.mapInArrow(tidy(take), f"id {types[id_col]}, url string, text string, n_chars long")
