"""Signatures, regions, differences and surveys over pages and documents as blocks of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from .common import table

#: (signature_id, vendor, pattern, weight, status, rank, expected offset up to).
RULES = (
    ("nav.list", "alpha", "<nav><ul>", 10.0, "validated", 3, 320), ("ad.box", "alpha", '<div class="ad">', 6.0, "spec", 2, 0),
    ("article.open", "beta", "<article><h1>", 4.0, "validated", 3, 0), ("break", "beta", "<br>", 1.5, "detected", 1, 0), ("footer.mark", "gamma", "<footer>&copy;", 3.0, "candidate", 0, 4000),
    ("none", "delta", "\x01nothing", 5.0, "spec", 2, 0),
)
KEEP = 200
STRETCH = 1 << 20


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:6] for r in RULES], "signature_id string, vendor string, pattern string, weight double, status string, rank int")


def _hits(spark, d) -> DataFrame:
    return detect.text_hits(table(spark, d, "pages"), "page_id", "html", _rules(spark))


def _expected():
    place = F.lit(False)
    for sid, *_, upto in RULES:
        place = F.when(F.col("signature_id") == sid, F.col("offset") <= upto).otherwise(place)
    return place


def hits(spark: SparkSession, d: str) -> DataFrame:
    """The first KEEP hits of each signature, and how many there are in all."""
    found = _hits(spark, d)
    counts = found.groupBy("signature_id").agg(F.count("*").alias("n"))
    return detect.kept_hits(found, KEEP).join(counts, "signature_id").select("signature_id", "vendor", "block", "offset", "n", _expected().alias("at_expected"))


def scores(spark, d) -> DataFrame:
    got = detect.vendor_scores(_hits(spark, d), _rules(spark), _expected(), KEEP)
    return got.select("vendor", "signatures", "hits", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


def weakest(spark, d) -> DataFrame:
    """The weakest state among the signatures that were found, for each vendor."""
    return detect.vendor_scores(_hits(spark, d), _rules(spark), _expected(), KEEP).select("vendor", "status")


def coverage(spark, d) -> DataFrame:
    """Every named vendor, those not found included; counted as found from a confidence of a half."""
    named = _rules(spark).select("vendor").distinct()
    got = detect.vendor_scores(_hits(spark, d), _rules(spark), _expected(), KEEP)
    return named.join(got, "vendor", "left").select("vendor", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(F.col("confidence") >= 0.5, F.lit(False)).alias("detected"))


def _blocks(spark, d) -> DataFrame:
    """Documents as blocks in a row: a piece of text each, with the counts that classes go by."""
    docs = table(spark, d, "documents")
    words, kinds = F.size(F.split("text", " ")), F.size(F.array_distinct(F.split("text", " ")))
    return docs.select(
        F.col("doc_id").alias("block"), F.lit(1).cast("bigint").alias("length"), F.col("n_chars"),
        F.regexp_count("text", F.lit("the")).alias("start_codes"), (kinds / words).alias("density"), F.regexp_count("text", F.lit("token|password")).alias("hits"), F.sha2("text", 256).alias("sha256"),
    )


def _classes(spark, d) -> DataFrame:
    kind = detect.region_class(F.col("start_codes") / 8, F.col("n_chars") * 1000, F.col("density"), F.col("hits"))
    return _blocks(spark, d).withColumn("kind", kind)


def region_summary(spark, d) -> DataFrame:
    """Blocks and bytes of each class, and the class's share of what is not empty, in tenths of a thousandth."""
    by = _classes(spark, d).groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("n_chars").alias("bytes"))
    total = by.where("kind <> 'empty'").agg(F.sum("blocks").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("kind", "blocks", "bytes", F.floor(F.col("blocks") * 10_000 / F.col("all")).cast("bigint").alias("share_e4"))


def region_runs(spark, d) -> DataFrame:
    return detect.class_runs(_classes(spark, d), "block", "length", "kind", 4096)


def codec_totals(spark, d) -> DataFrame:
    """Sums of the per-block census, and the likely codec by its rule."""
    b = _blocks(spark, d).agg(F.sum("start_codes").alias("start_codes"), F.sum("hits").alias("sps"), F.count_if(F.col("density") > 0.9).alias("hevc_ps"))
    likely = F.when((F.col("hevc_ps") > F.col("sps")) & (F.col("hevc_ps") > 0), "h265").when((F.col("sps") > 0) | (F.col("start_codes") > 1000), "h264").otherwise("")
    return b.select("*", likely.alias("likely"))


def _second_map(a: DataFrame) -> DataFrame:
    """The same disk later: some blocks written again, some gone, some new."""
    moved = F.when(F.col("block") % 10 == 3, F.col("block") + 1_000_000_000).otherwise(F.col("block"))
    return a.where("block % 17 <> 5").select(moved.alias("block"), F.when(F.col("block") % 7 == 2, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256"))


def map_diff(spark, d) -> DataFrame:
    a = _blocks(spark, d).select("block", "sha256")
    return detect.blockmap_diff(a, _second_map(a), "block", "sha256")


def changed_runs(spark, d) -> DataFrame:
    """Neighbouring blocks that changed, as runs."""
    changed = map_diff(spark, d).where("state = 'changed'").withColumn("length", F.lit(1).cast("bigint"))
    return detect.class_runs(changed, "block", "length", "state", 4096).drop("state")


def _tokens(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]{2,}"), F.lit(0))).alias("token"))


def token_survey(spark, d) -> DataFrame:
    samples = table(spark, d, "documents").agg(F.count("*").alias("samples"))
    return detect.token_survey(_tokens(spark, d), samples)


def token_gaps(spark, d) -> DataFrame:
    """Commonest distance, in words, between neighbouring places of each word."""
    words = table(spark, d, "documents").select(F.col("doc_id").alias("sample"), F.posexplode(F.split("text", " ")).alias("at", "token"))
    return detect.modal_gap(words.where("token <> ''"), "token", "sample", "at")


def string_census(spark, d) -> DataFrame:
    """Printable runs of twelve and more word characters, of four and more kinds, that occur twice and more: the forty commonest."""
    runs = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{12,}"), F.lit(0))).alias("string"))
    counts = runs.groupBy("string").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.size(F.array_distinct(F.split("string", ""))) >= 4))
    return counts.orderBy(F.desc("n"), "string").limit(40)


_VALUES = "rules(signature_id, vendor, pattern, weight, status, rank, upto) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {w}::DOUBLE, '{s}', {k}, {u})" for a, b, c, w, s, k, u in RULES) + ")"
_HITS = f"""WITH {_VALUES}, pieces AS (SELECT page_id, r.*, string_split(html, pattern) AS parts FROM pages, rules r WHERE contains(html, pattern)),
    hits AS (SELECT signature_id, vendor, page_id AS block, upto, k, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(pattern) AS BIGINT) AS offset_ FROM pieces, unnest(range(1, len(parts))) AS t(k)),
    kept AS (SELECT *, offset_ <= upto AS at_expected FROM hits QUALIFY row_number() OVER (PARTITION BY signature_id ORDER BY block, offset_) <= {KEEP}),
    counts AS (SELECT signature_id, count(*) AS n FROM hits GROUP BY 1)"""
_SCORES = _HITS + f""", each AS (SELECT r.*, c.n, (SELECT bool_or(at_expected) FROM kept k WHERE k.signature_id = c.signature_id) AS placed FROM counts c JOIN rules r USING (signature_id)),
    by_vendor AS (SELECT vendor, count(*) AS signatures, CAST(sum(n) AS BIGINT) AS hits, sum(weight * (1 + placed::INT) * (1 + log10(least(n, {detect.HIT_CAP})))) AS raw, arg_min(status, rank) AS status FROM each GROUP BY 1),
    scored AS (SELECT vendor, signatures, hits, status, raw * (1 + {detect.BREADTH} * (signatures - 1)) AS score FROM by_vendor)"""
_BLOCKS = "b AS (SELECT doc_id AS block, n_chars, len(regexp_extract_all(text, 'the')) AS start_codes, len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')) AS density, len(regexp_extract_all(text, 'token|password')) AS hits, sha256(text) AS sha256 FROM documents)"
_CLASSES = f"WITH {_BLOCKS}, lim AS (SELECT *, n_chars * 1000 / 16777216.0::DOUBLE AS ch FROM b), c AS (SELECT *, CASE WHEN start_codes / 8 > ch + 6 * sqrt(ch) + 4 THEN 'video' WHEN density < 0.05 THEN 'empty' WHEN density < 0.95 AND hits = 0 THEN 'structured' WHEN hits > 0 THEN 'container_without_video' ELSE 'unstructured' END AS kind FROM lim)"
_RUNS = "r AS (SELECT *, sum(CASE WHEN pk IS NULL OR pk <> kind OR pb + 1 <> block THEN 1 ELSE 0 END) OVER (ORDER BY block) AS run_ FROM (SELECT *, lag(kind) OVER (ORDER BY block) AS pk, lag(block) OVER (ORDER BY block) AS pb FROM c))"
_DIFF = f"""WITH {_BLOCKS}, a2 AS (SELECT CASE WHEN block % 10 = 3 THEN block + 1000000000 ELSE block END AS k2, CASE WHEN block % 7 = 2 THEN sha256(sha256 || 'x') ELSE sha256 END AS v2 FROM b WHERE block % 17 <> 5),
    diff AS (SELECT coalesce(block, k2) AS block, CASE WHEN k2 IS NULL THEN 'only_first' WHEN block IS NULL THEN 'only_second' WHEN sha256 <> v2 THEN 'changed' END AS state FROM b FULL JOIN a2 ON block = k2)"""

QUERIES = {
    "a1_signature_hits": hits, "a2_vendor_scores": scores, "a3_weakest_status": weakest, "a4_coverage_statement": coverage, "b8_a5_region_summary": region_summary,
    "w6_region_runs": region_runs, "b7_a6_codec_totals": codec_totals, "j11_map_diff": map_diff, "w7_changed_runs": changed_runs, "a23_token_survey": token_survey, "a24_token_gaps": token_gaps, "a25_string_census": string_census,
}

ORACLE_SQL = {
    "a1_signature_hits": _HITS + " SELECT signature_id, vendor, block, offset_ AS \"offset\", n, at_expected FROM kept JOIN counts USING (signature_id)",
    "a2_vendor_scores": _SCORES + f" SELECT vendor, signatures, hits, round(score, 6) AS score, round(1 - exp(-score / {detect.SCALE}), 6) AS confidence FROM scored",
    "a3_weakest_status": _SCORES + " SELECT vendor, status FROM scored",
    "a4_coverage_statement": _SCORES + f" SELECT v.vendor, coalesce(hits, 0) AS hits, coalesce(1 - exp(-score / {detect.SCALE}) >= 0.5, false) AS detected FROM (SELECT DISTINCT vendor FROM rules) v LEFT JOIN scored USING (vendor)",
    "b8_a5_region_summary": _CLASSES + ", g AS (SELECT kind, count(*) AS blocks, CAST(sum(n_chars) AS BIGINT) AS bytes FROM c GROUP BY 1) SELECT *, CAST(floor(blocks * 10000 / (SELECT sum(blocks) FROM g WHERE kind <> 'empty')) AS BIGINT) AS share_e4 FROM g",
    "w6_region_runs": _CLASSES + f", {_RUNS} SELECT kind, min(block) AS run, count(*) AS blocks, count(*) AS bytes FROM r GROUP BY kind, run_",
    "b7_a6_codec_totals": f"WITH {_BLOCKS}, t AS (SELECT CAST(sum(start_codes) AS BIGINT) AS start_codes, CAST(sum(hits) AS BIGINT) AS sps, count(*) FILTER (WHERE density > 0.9) AS hevc_ps FROM b) SELECT *, CASE WHEN hevc_ps > sps AND hevc_ps > 0 THEN 'h265' WHEN sps > 0 OR start_codes > 1000 THEN 'h264' ELSE '' END AS likely FROM t",
    "j11_map_diff": _DIFF + " SELECT * FROM diff WHERE state IS NOT NULL",
    "w7_changed_runs": _DIFF + ", c AS (SELECT block, state AS kind FROM diff WHERE state = 'changed'), " + _RUNS + " SELECT min(block) AS run, count(*) AS blocks, count(*) AS bytes FROM r GROUP BY run_",
    "a23_token_survey": "WITH t AS (SELECT doc_id AS sample, unnest(regexp_extract_all(text, '[a-z]{2,}')) AS token FROM documents), c AS (SELECT token, count(*) AS n, count(DISTINCT sample) AS in_samples FROM t GROUP BY 1), m AS (SELECT n AS median FROM c ORDER BY n LIMIT 1 OFFSET (SELECT count(*) // 2 FROM c)), k AS (SELECT count(*) AS samples FROM documents) SELECT token, n, in_samples, median FROM c, m, k WHERE n >= 50 AND in_samples >= 0.1::DOUBLE * samples AND n >= 20 * median",
    "a24_token_gaps": "WITH w AS (SELECT doc_id AS sample, k, string_split(text, ' ')[k] AS token FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) AS t(k)), g AS (SELECT token, lead(k) OVER (PARTITION BY token, sample ORDER BY k) - k AS gap FROM w WHERE token <> ''), c AS (SELECT token, gap, count(*) AS times FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT token, CAST(arg_max(gap, times * 1000000 - gap) AS INTEGER) AS gap, max(times) AS times, CAST(sum(times) AS BIGINT) AS places FROM c GROUP BY 1",
    "a25_string_census": "WITH r AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]{12,}')) AS string FROM documents) SELECT string, count(*) AS n FROM r GROUP BY 1 HAVING n >= 2 AND len(list_distinct(string_split(string, ''))) >= 4 ORDER BY n DESC, string LIMIT 40",
}
