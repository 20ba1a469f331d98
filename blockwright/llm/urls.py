"""URL filters with redirect equivalence, in DataFrame operations only.

A rule names a host and a path prefix; the longest rule that fits a URL judges it. URLs that redirects or
canonical links tie together are aliases: connected components over those edges carry a block to every alias that
no rule of its own judges. An explicit allow of a URL stands against a block of its aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A link or meta tag that names another address of the same page; the address is quoted, or ends at a blank or the tag's end.
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
#: The address in a refresh's content, quoted again or not.
TARGET = r"""(?i)\burl\s*=\s*(?:'([^']*)'|"([^"]*)"|([^\s"']+))"""
#: Character references that addresses hold (fixed values).
REFERENCES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x3A;", ":"), ("&#58;", ":"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule, or null. Equal lengths: the later in the alphabet."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _plain(url: Column) -> Column:
    """The form that addresses are compared in: scheme and host in small letters, and no fragment, which names no other address."""
    kept = F.regexp_replace(url, "#.*$", "")
    front = F.regexp_extract(kept, "^[^/?#]*://[^/?#]*", 0)
    return F.concat(F.translate(front, UPPER, LOWER), kept.substr(F.length(front) + 1, F.length(kept)))


def _decoded(text: Column) -> Column:
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(text)


def _without_dots(path: Column) -> Column:
    """A path whose . and .. parts have been followed."""

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(part == ".", done).otherwise(F.array_append(done, part))

    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.when((F.size(kept) > 0) & F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), last)


def resolved(base: Column, to: Column) -> Column:
    """The address that a page at ``base`` means by ``to``: whole, by the same scheme, from the root, by another query, or beside the page. Null for other schemes."""
    scheme = F.regexp_extract(base, "^([^/?#]*)://", 1)
    origin, path = F.regexp_extract(base, "^[^/?#]*://[^/?#]*", 0), url_path(base)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, "^/?(.*/)?", 1))
    tail, own = F.regexp_extract(to, "[?#].*$", 0), F.regexp_extract(to, "^[^?#]*", 0)
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(own == "", F.concat(origin, path, tail)).otherwise(F.concat(origin, _without_dots(F.when(to.startswith("/"), own).otherwise(F.concat(folder, own))), tail))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) of canonical links and refresh redirects in the pages, in the form that addresses are compared in; relative ones are completed."""
    url, html = F.col(url_col), F.col(html_col)
    found = lambda pattern: [F.regexp_extract_all(html, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    told = lambda pattern, whole: F.transform(F.concat(*found(pattern)), lambda x: F.struct(x.alias("text"), F.lit(whole).alias("whole")))
    marked = pages.where(url.contains("://") & html.rlike("(?i)canonical|http-equiv")).select(url.alias("url"), F.explode(F.concat(told(CANONICAL, True), told(REFRESH, False))).alias("c"))
    text = _decoded(F.col("c.text"))
    target = F.concat(*[F.regexp_extract(text, TARGET, k) for k in (1, 2, 3)])
    named = marked.select("url", F.when(F.col("c.whole"), text).otherwise(F.trim(target)).alias("to")).where("to <> ''")
    return named.select(_plain(F.col("url")).alias("src"), _plain(resolved(F.col("url"), F.col("to"))).alias("dst")).where(F.col("dst").contains("://"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, aliased) for every page.

    ``redirects``: more edges (src, dst) between URLs. The verdict is the longest rule's; without a rule it is block
    if some URL of the same component is blocked by a rule, else allow. A null URL, or one without ``://``, has an
    empty host and path, fits no rule and has no alias. Repeated rows are judged alike and stay; an empty table gives
    no rows. Pages of any length are searched whole; other columns are not looked at, whatever their names.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_plain(F.col("src")).alias("src"), _plain(F.col("dst")).alias("dst")))
    parts = connected_components(edges)
    ruled = parts.select("node", "component", longest_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"].alias("verdict"))
    bad = ruled.where("verdict = 'block'").select("component").distinct()
    tainted = parts.join(bad, "component", "left_semi").select("node").distinct()
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    own = own.select("id", _plain(F.col("url")).alias("plain"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    own = own.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules))
    joined = own.join(tainted, own.plain == tainted.node, "left")
    return joined.select(
        "id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("node").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )


def oracle(rules=RULES) -> str:
    """The same over the view ``pages`` in DuckDB's SQL: tags first, then their attributes, and every alias of every address."""
    rest = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
    host = lambda u: f"translate(coalesce(regexp_extract({rest(u)}, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}')"
    path = lambda u: f"coalesce(regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1), '')"
    plain = lambda u: f"translate(regexp_extract({u}, '^[^/?#]*://[^/?#]*'), '{UPPER}', '{LOWER}') || substr(regexp_replace({u}, '#.*$', ''), length(regexp_extract({u}, '^[^/?#]*://[^/?#]*')) + 1)"
    quoted = lambda c: "'" + c.replace("'", "''") + "'"
    decoded = lambda t: "trim(" + "replace(" * len(REFERENCES) + t + "".join(f", '{n}', {quoted(c)})" for n, c in REFERENCES) + ")"
    unquoted = lambda t: f"CASE WHEN starts_with({t}, '\"') OR starts_with({t}, '''') THEN substr({t}, 2, length({t}) - 2) ELSE {t} END"
    attribute = lambda name: f"""regexp_extract(tag, '(?i)\\b{name}\\s*=\\s*("[^"]*"|''[^'']*''|[^"''\\s>]+)', 1)"""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    ruled = lambda src, keys: f"""SELECT {keys}, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM {src} s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY {keys}"""  # noqa: E731
    return f"""
    WITH RECURSIVE rules(host, path, verdict) AS (VALUES {values}),
    p AS (SELECT row_number() OVER () AS k, page_id, {plain('url')} AS plain, {host('url')} AS host, {path('url')} AS path, url, html FROM pages),
    tags AS (SELECT url, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE contains(url, '://')),
    given AS (SELECT url, path, true AS whole, {attribute('href')} AS q FROM tags WHERE regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')
        UNION ALL SELECT url, path, false, {attribute('content')} FROM tags WHERE regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
    read AS (SELECT url, path, whole, {decoded(unquoted('q'))} AS d FROM given),
    aimed AS (SELECT url, path, whole, d, regexp_extract(d, '(?i)\\burl\\s*=\\s*(''[^'']*''|"[^"]*"|[^\\s"'']+)', 1) AS a FROM read),
    named AS (SELECT url, path, CASE WHEN whole THEN d ELSE trim({unquoted('a')}) END AS t FROM aimed),
    cut AS (SELECT url, t, path, regexp_extract(url, '^[^/?#]*://[^/?#]*') AS origin, regexp_extract(t, '^[^?#]*') AS own, regexp_extract(t, '[?#].*$') AS tail FROM named WHERE t <> ''),
    way AS (SELECT *, string_split(regexp_replace(CASE WHEN starts_with(own, '/') THEN own ELSE '/' || regexp_extract(path, '^/?(.*/)?', 1) || own END, '^/', ''), '/') AS parts FROM cut),
    walked AS (SELECT *, list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform(parts, lambda x: [x])), lambda a, b: CASE WHEN b[1] = '..' THEN a[:-2] WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END) AS kept FROM way),
    hrefs AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^/?#]*)://', 1) || ':' || t
        WHEN own = '' THEN origin || path || tail ELSE origin || '/' || array_to_string(kept, '/') || CASE WHEN len(kept) > 0 AND parts[-1] IN ('.', '..') THEN '/' ELSE '' END || tail END AS t FROM walked),
    e AS (SELECT {plain('url')} AS src, {plain('t')} AS dst FROM hrefs WHERE t IS NOT NULL),
    both_ways AS (SELECT src AS u, dst AS v FROM e WHERE contains(dst, '://') UNION SELECT dst, src FROM e WHERE contains(dst, '://')),
    reach(n, m) AS (SELECT u, u FROM both_ways UNION SELECT r.n, b.v FROM reach r JOIN both_ways b ON b.u = r.m),
    seen AS (SELECT DISTINCT m AS node, {host('m')} AS host, {path('m')} AS path FROM reach),
    judged AS ({ruled('seen', 's.node')}),
    tainted AS (SELECT DISTINCT r.n AS node FROM reach r JOIN judged j ON j.node = r.m WHERE j.verdict = 'block'),
    own AS ({ruled('p', 's.k')})
    SELECT p.page_id, p.host, p.path, o.rule, coalesce(o.verdict, CASE WHEN t.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN own o ON o.k = p.k LEFT JOIN tainted t ON t.node = p.plain"""
