"""Index chains and the place of their data, tokens and identifiers in bytes, pictures, and plane geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import US
from ..operators import chains, geometry, identify, pictures, sequence, store, survey
from .common import RECORDINGS, recordings, table

#: Bytes of a stand-in cluster, and of a slot's place before the data begin.
SIZE, FIRST = 4096, 1 << 20


def slots(spark, d) -> DataFrame:
    """An index made of orders: a customer's orders are a file's slots, some of whose links lead back, astray or to a wrong slot."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    all_ = Window.partitionBy("o_custkey")
    at = o.select(
        "o_custkey", F.col("o_orderkey").alias("idx"), F.row_number().over(w).alias("n"), F.coalesce(F.lead("o_orderkey").over(w), F.lit(0)).alias("on"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(0)).alias("back"),
        F.count("*").over(all_).alias("all"), F.min(F.struct("o_orderkey")).over(all_)["o_orderkey"].alias("first"),
    )
    second = F.min(F.when(F.col("n") == 2, F.col("idx"))).over(all_)
    nxt = F.when((F.col("idx") % 41 == 3) & (F.col("n") > 1), second).when(F.col("idx") % 43 == 4, F.col("first")).when(F.col("idx") % 53 == 5, F.col("idx") + 1).otherwise(F.col("on"))
    return at.select(
        (F.col("o_custkey") % 7).alias("volume"), "idx", F.when(F.col("n") == 1, 1).otherwise(2).alias("kind"), nxt.alias("next"), F.when(F.col("idx") % 59 == 7, F.lit(0)).otherwise(F.col("back")).alias("prev"),
        F.when(F.col("n") == 1, F.col("all") - 1 + F.when(F.col("idx") % 61 == 8, 1).otherwise(0)).otherwise(F.col("n") - 1).cast("bigint").alias("seq"),
    )


def index_chains(spark, d) -> DataFrame:
    return chains.chain_files(slots(spark, d))


def _calibration(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cameras as volumes: recordings in order are slots, and most of them have footage at their place, a little late."""
    rec = sequence.row_numbers(recordings(spark, d), ["camera"], "s", ["event_id"])
    volume = F.pmod(F.ascii("camera") * 31 + F.length("camera"), F.lit(97)).cast("bigint")
    at = rec.select(volume.alias("volume"), F.col("_n").alias("idx"), F.floor(F.col("s") / US).cast("bigint").alias("start_s"), F.floor(F.col("e") / US).cast("bigint").alias("end_s"), "event_id")
    at = store.once(at)  # slots and marks are both read twice
    heads = at.select("volume", "idx", "start_s", "end_s", F.lit(0).cast("bigint").alias("vol_start"))
    marks = at.where("event_id % 5 <> 0").select(
        "volume", (FIRST + F.col("volume") * 512 + F.col("idx") * SIZE).alias("offset"), (F.col("start_s") + F.col("event_id") % 3).alias("first_s"), (F.col("end_s") - F.col("event_id") % 2).alias("last_s")
    )
    return heads, marks


def data_base(spark, d) -> DataFrame:
    heads, marks = _calibration(spark, d)
    got = chains.data_base(heads, marks, SIZE)
    return got.select("volume", "base", "votes", "found", F.round("error_s", 6).alias("error_s"), F.round("runner_up_s", 6).alias("runner_up_s"))


TOKENS = (b"the ", b" of ", b"tion")


def token_geometry(spark, d) -> DataFrame:
    return survey.token_geometry(table(spark, d, "documents").select(F.col("text").alias("data")), list(TOKENS))


def token_fields(spark, d) -> DataFrame:
    """The field of each token that most often is the distance to its next place."""
    got = survey.token_fields(token_geometry(spark, d))
    return got.select("token", "places", "length_offset", "length_width", F.round("length_share", 9).alias("length_share"), F.size("dates").alias("dates"))


def _units(spark, d) -> DataFrame:
    """A supplier's line items as NAL units, types and first slices by their numbers."""
    by = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at")).agg(F.min("l_partkey").alias("p"))
    return by.select("l_suppkey", "at", (F.col("p") % 9 + 1).cast("int").alias("type"), (F.col("p") % 4 == 0).alias("first"))


def picture_table(spark, d) -> DataFrame:
    return pictures.picture_table(_units(spark, d), ["l_suppkey"], "at", "type", "first", 1 << 15)


def identifiers(spark, d) -> DataFrame:
    """Long words of the benchmark as identifiers, counted as whole tokens of every document."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct().collect()
    wanted = identify.forms([("text", r["w"]) for r in words])  # a stated set; its size is checked where automata are made
    none = F.lit(None).cast("binary")
    blocks = table(spark, d, "documents").select(F.col("doc_id").alias("offset"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"), none.alias("before"), none.alias("after"))
    return identify.identifier_hits(blocks, wanted).groupBy("identifier").agg(F.count("*").alias("n"))


def similarity(spark, d) -> DataFrame:
    """The transform of an order's points (quantity, discount) to those of its parts and suppliers."""
    p = F.struct(F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount") * 100).cast("double").alias("y"))
    t = F.struct((F.col("l_partkey") % 97).cast("double").alias("x"), (F.col("l_suppkey") % 53).cast("double").alias("y"))
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(p.alias("p"), t.alias("t"))).alias("r"))
    got = by.select("l_orderkey", geometry.similarity(F.transform("r", lambda x: x["p"]), F.transform("r", lambda x: x["t"])).alias("m")).where("m is not null")
    return got.select("l_orderkey", *[(F.round(F.col(f"m.{c}"), 8) + 0.0).alias(c) for c in "abxy"])


def tiled(spark, d) -> DataFrame:
    """Parts as pictures, cut into tiles of 256 that overlap by 32."""
    pictures_ = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 19).cast("int").alias("w"), (F.col("p_partkey") % 700).cast("int").alias("h"))
    return geometry.tiles(pictures_, "w", "h", 256, 32).select("p_partkey", "tile_x", "tile_y", "tile_w", "tile_h")


QUERIES = {
    "o10_index_chains": index_chains, "a22_data_base": data_base, "a24_token_geometry": token_geometry, "a24_token_fields": token_fields, "w20_pictures": picture_table, "fn_identifiers": identifiers,
    "fn_similarity": similarity, "fn_tiles": tiled,
}

_TOKENS = ", ".join(f"('{t.decode()}', '{t.hex().upper()}')" for t in TOKENS)
_BYTE = "list_sum(list_transform(range(w), lambda k: (('0x' || substr(h, 2 * (i + o + k) + 1, 2))::BIGINT) << (8 * k)))"
_GEOMETRY = f"""WITH tokens(token, th) AS (VALUES {_TOKENS}), d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, h, token, r.i AS i FROM d, tokens, LATERAL (SELECT unnest(range(0, length(h) // 2)) AS i) r WHERE substr(h, 2 * r.i + 1, length(th)) = th),
    g AS (SELECT *, lead(i) OVER (PARTITION BY doc_id, token ORDER BY i) - i AS gap FROM p),
    f AS (SELECT token, gap, o, w, CASE WHEN 2 * (i + o + w) <= length(h) THEN {_BYTE} END AS v FROM g, range(4, 32, 2) t(o), (VALUES (1), (2), (4)) x(w)),
    y AS (SELECT *, w = 4 AND o % 4 = 0 AS dated, (v >> 26 & 63) + 2000 AS ye, v >> 22 & 15 AS mo, v >> 17 & 31 AS da, v >> 12 & 31 AS ho, v >> 6 & 63 AS mi, v & 63 AS se FROM f),
    geo AS (SELECT token, CAST(o AS INTEGER) AS "offset", w AS width, count(*) AS places, count(gap) AS pairs, count(*) FILTER (WHERE v = gap) AS equal,
        count(*) FILTER (WHERE dated AND v BETWEEN epoch(TIMESTAMP '2005-01-01') AND epoch(TIMESTAMP '2035-01-01')) AS unix,
        count(*) FILTER (WHERE dated AND ye BETWEEN 2005 AND 2035 AND mo BETWEEN 1 AND 12 AND da >= 1 AND ho < 24 AND mi < 60 AND se < 60) AS packed FROM y GROUP BY 1, 2, 3)"""

_SLOTS = """o AS (SELECT o_custkey, o_orderkey AS idx, row_number() OVER w AS n, coalesce(lead(o_orderkey) OVER w, 0) AS onward, coalesce(lag(o_orderkey) OVER w, 0) AS back, count(*) OVER (PARTITION BY o_custkey) AS al,
    min(o_orderkey) OVER (PARTITION BY o_custkey) AS fst FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
o2 AS (SELECT *, min(CASE WHEN n = 2 THEN idx END) OVER (PARTITION BY o_custkey) AS snd FROM o),
slots AS (SELECT o_custkey % 7 AS volume, idx, CASE WHEN n = 1 THEN 1 ELSE 2 END AS kind, CASE WHEN idx % 41 = 3 AND n > 1 THEN snd WHEN idx % 43 = 4 THEN fst WHEN idx % 53 = 5 THEN idx + 1 ELSE onward END AS next,
    CASE WHEN idx % 59 = 7 THEN 0 ELSE back END AS prev, CASE WHEN n = 1 THEN al - 1 + CASE WHEN idx % 61 = 8 THEN 1 ELSE 0 END ELSE n - 1 END AS seq FROM o2)"""

ORACLE_SQL = {
    # One slot after the other, with the list of those seen.
    "o10_index_chains": f"""WITH RECURSIVE {_SLOTS}, walk AS (SELECT volume, idx AS head, 0 AS place, idx, next, [idx] AS seen, false AS wrong, seq AS declared FROM slots WHERE kind = 1
    UNION ALL SELECT w.volume, w.head, w.place + 1, s.idx, s.next, list_append(w.seen, s.idx), w.wrong OR s.prev <> w.idx OR s.seq <> w.place + 1, w.declared FROM walk w JOIN slots s ON s.volume = w.volume AND s.idx = w.next AND s.kind = 2 WHERE w.next <> 0 AND NOT list_contains(w.seen, w.next)),
    ends AS (SELECT *, row_number() OVER (PARTITION BY volume, head ORDER BY place DESC) AS r FROM walk),
    told AS (SELECT volume, head, place + 1 AS n, idx AS last, CASE WHEN next <> 0 AND list_contains(seen, next) THEN 'loop' WHEN next <> 0 THEN 'broken link' WHEN wrong THEN 'back link differs' WHEN declared <> place THEN 'count differs' ELSE '' END AS note FROM ends WHERE r = 1)
    SELECT volume, head, n, last, note = '' AS ok, note FROM told""",
    # Every mark against every slot of its volume, then every candidate against every slot.
    "a22_data_base": f"""WITH {RECORDINGS}, s AS (SELECT (ascii(camera) * 31 + length(camera)) % 97 AS volume, row_number() OVER (PARTITION BY camera ORDER BY s, event_id) - 1 AS idx, s // 1000000 AS a, e // 1000000 AS z, event_id FROM rec),
    m AS (SELECT volume, {FIRST} + volume * 512 + idx * {SIZE} AS offs, a + event_id % 3 AS f, z - event_id % 2 AS l FROM s WHERE event_id % 5 <> 0),
    votes AS (SELECT s.volume, m.offs - s.idx * {SIZE} AS base, count(*) AS v FROM m JOIN s ON s.volume = m.volume AND s.a BETWEEN m.f - 12 AND m.f + 1 AND m.f BETWEEN s.a - 2 AND s.z + 2 WHERE m.offs - s.idx * {SIZE} >= 0 GROUP BY 1, 2),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY v DESC, base) AS r FROM votes) WHERE r <= 8),
    cand AS (SELECT DISTINCT volume, base + k * {SIZE} AS base FROM top, range(-3, 4) t(k) WHERE base + k * {SIZE} >= 0),
    hit AS (SELECT c.volume, c.base, abs(m.f - s.a) + abs(m.l - s.z) AS d FROM cand c JOIN s ON s.volume = c.volume JOIN m ON m.volume = c.volume AND m.offs = c.base + s.idx * {SIZE} WHERE m.f BETWEEN s.a - 2 AND s.z + 2),
    score AS (SELECT volume, base, count(*) AS found, sum(d) / (2.0 * count(*)) AS err FROM hit GROUP BY 1, 2),
    fit AS (SELECT *, max(found) OVER (PARTITION BY volume) AS most FROM score), w AS (SELECT fit.volume, fit.base, coalesce(v, 0) AS votes, found, err, row_number() OVER o AS r, lead(err) OVER o AS second FROM fit LEFT JOIN votes USING (volume, base) WHERE found >= 0.8 * most WINDOW o AS (PARTITION BY fit.volume ORDER BY err, coalesce(v, 0) DESC, fit.base))
    SELECT volume, base, votes, found, round(err, 6) AS error_s, round(second, 6) AS runner_up_s FROM w WHERE r = 1""",
    "a24_token_geometry": _GEOMETRY + " SELECT * FROM geo",
    "a24_token_fields": _GEOMETRY + """, l AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY equal DESC, width DESC, "offset") AS r FROM geo), n AS (SELECT token, least(3, count(*) FILTER (WHERE unix * 2 >= places) + count(*) FILTER (WHERE packed * 2 >= places)) AS dates FROM geo GROUP BY 1)
    SELECT token, places, CASE WHEN equal > 0 THEN "offset" END AS length_offset, CASE WHEN equal > 0 THEN width END AS length_width, CASE WHEN equal > 0 THEN round(equal / pairs, 9) END AS length_share, CAST(dates AS INTEGER) AS dates FROM l JOIN n USING (token) WHERE r = 1""",
    # One unit after the other, with whether the picture has had a slice.
    "w20_pictures": """WITH RECURSIVE g AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pl, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), u AS (SELECT l_suppkey, pl, p % 9 + 1 AS type, p % 4 = 0 AS fst FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pl) AS k FROM u),
    walk AS (SELECT l_suppkey, k, pl, type, pl AS picture, type BETWEEN 1 AND 5 AS seen FROM n WHERE k = 1
        UNION ALL SELECT n.l_suppkey, n.k, n.pl, n.type, CASE WHEN b THEN n.pl ELSE w.picture END, n.type BETWEEN 1 AND 5 OR (w.seen AND NOT b) FROM walk w JOIN n ON n.l_suppkey = w.l_suppkey AND n.k = w.k + 1,
        LATERAL (SELECT w.seen AND (n.type IN (6, 7, 8, 9) OR n.type BETWEEN 14 AND 18 OR (n.type BETWEEN 1 AND 5 AND n.fst)) AS b) x)
    SELECT l_suppkey, picture, count(*) AS nals, count(*) FILTER (WHERE type BETWEEN 1 AND 5) AS slices, bool_or(type = 5) AS key, max(pl) AS last FROM walk GROUP BY 1, 2""",
    "fn_identifiers": "WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{8,}'))) AS identifier FROM benchmark), t AS (SELECT unnest(list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda x: lower(x))) AS identifier FROM documents) SELECT identifier, count(*) AS n FROM t JOIN w USING (identifier) GROUP BY 1",
    "fn_similarity": """WITH p AS (SELECT l_orderkey, l_quantity::DOUBLE AS px, (l_discount * 100)::DOUBLE AS py, (l_partkey % 97)::DOUBLE AS tx, (l_suppkey % 53)::DOUBLE AS ty FROM lineitem),
    m AS (SELECT l_orderkey, avg(px) AS mx, avg(py) AS my, avg(tx) AS nx, avg(ty) AS ny, count(*) AS n FROM p GROUP BY 1),
    s AS (SELECT l_orderkey, sum((px - mx) * (tx - nx) + (py - my) * (ty - ny)) AS c, sum((px - mx) * (ty - ny) - (py - my) * (tx - nx)) AS d, sum((px - mx) ** 2 + (py - my) ** 2) AS w FROM p JOIN m USING (l_orderkey) GROUP BY 1),
    r AS (SELECT l_orderkey, c / w AS a, d / w AS b, mx, my, nx, ny FROM s JOIN m USING (l_orderkey) WHERE n >= 2 AND w > 0)
    SELECT l_orderkey, round(a, 8) + 0.0 AS a, round(b, 8) + 0.0 AS b, round(nx - a * mx + b * my, 8) + 0.0 AS x, round(ny - b * mx - a * my, 8) + 0.0 AS y FROM r""",
    "fn_tiles": """WITH p AS (SELECT p_partkey, p_size * 19 AS w, p_partkey % 700 AS h FROM part), q AS (SELECT * FROM p WHERE w > 0 AND h > 0),
    x AS (SELECT p_partkey, w, h, unnest(CASE WHEN w <= 256 THEN [0] ELSE list_transform(range(0, CAST(ceil((w - 256) / 224.0) AS INT) + 1), lambda k: least(k * 224, w - 256)) END) AS tx FROM q),
    y AS (SELECT *, unnest(CASE WHEN h <= 256 THEN [0] ELSE list_transform(range(0, CAST(ceil((h - 256) / 224.0) AS INT) + 1), lambda k: least(k * 224, h - 256)) END) AS ty FROM x)
    SELECT p_partkey, CAST(tx AS INT) AS tile_x, CAST(ty AS INT) AS tile_y, CAST(least(256, w) AS INT) AS tile_w, CAST(least(256, h) AS INT) AS tile_h FROM y""",
}
