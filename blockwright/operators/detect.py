"""Signature hits and scores, region classes, block-map differences, and the survey of unknown formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import runs, with_previous

#: Hits kept of each signature; bonus and thresholds of the score (fixed values).
KEPT_HITS, HIT_CAP, BREADTH, SCALE = 500, 10_000, 0.30, 18.0
#: Region limits (fixed values).
DENSE, EMPTY, CHANCE_BITS, MOSTLY = 0.95, 0.05, 24, 0.5
#: Ranks of validation states, weakest first (fixed values).
STATUS_RANK = {"candidate": 0, "detected": 1, "spec": 2, "validated": 3}


def _named(sid: str, vendor: str):
    return lambda at: F.struct(F.lit(sid).alias("signature_id"), F.lit(vendor).alias("vendor"), at.alias("offset"))


def text_hits(df: DataFrame, id_col: str, text_col: str, rules: DataFrame) -> DataFrame:
    """(signature_id, vendor, block, offset): non-overlapping finds of each rule's literal pattern, offsets from 0.

    Rules are (signature_id, vendor, pattern), a short list by nature; each text is searched for all of them at once.
    """
    listed = [(r["signature_id"], r["vendor"], r["pattern"]) for r in rules.collect()]
    places = []
    for sid, vendor, pattern in listed:
        lengths = F.transform(F.split(F.col(text_col), "\\Q" + pattern + "\\E", -1), lambda x: F.length(x))
        # The k-th find starts after the first k pieces and k - 1 patterns.
        starts = F.aggregate(F.slice(lengths, 1, F.size(lengths) - 1), F.array().cast("array<bigint>"), lambda acc, n: F.concat(acc, F.array((F.when(F.size(acc) > 0, F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) + len(pattern)).otherwise(F.lit(0)) + n).cast("bigint"))))
        places.append(F.transform(F.when(F.contains(F.col(text_col), F.lit(pattern)), starts).otherwise(F.array().cast("array<bigint>")), _named(sid, vendor)))
    return df.select(F.col(id_col).alias("block"), F.explode(F.concat(*places)).alias("hit")).select("hit.signature_id", "hit.vendor", "block", "hit.offset")


def kept_hits(hits: DataFrame, keep: int = KEPT_HITS) -> DataFrame:
    """The first hits of each signature by block and offset. Tasks keep their own first hits before any meet."""
    local = Window.partitionBy("signature_id", "_t").orderBy("block", "offset")
    first = Window.partitionBy("signature_id").orderBy("block", "offset")
    some = hits.withColumn("_t", F.pmod(F.xxhash64("block"), F.lit(256))).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= keep)
    return some.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep).drop("_r", "_t")


def vendor_scores(hits: DataFrame, rules: DataFrame, expected: Column, keep: int = KEPT_HITS) -> DataFrame:
    """(vendor, signatures, hits, score, confidence): weight, doubled where a kept hit stands at an expected place, by the logarithm of the hits; several signatures strengthen each other."""
    counts = hits.groupBy("signature_id").agg(F.count("*").alias("n"))
    placed = kept_hits(hits, keep).groupBy("signature_id").agg(F.max(expected.cast("int")).alias("placed"))
    each = counts.join(placed, "signature_id").join(F.broadcast(rules), "signature_id")
    part = F.col("weight") * (1 + F.col("placed")) * (1 + F.log10(F.least("n", F.lit(HIT_CAP)).cast("double")))
    by = each.groupBy("vendor").agg(F.count("*").alias("signatures"), F.sum("n").alias("hits"), F.sum(part).alias("raw"), F.min_by("status", "rank").alias("status"))
    score = F.col("raw") * (1 + BREADTH * (F.col("signatures") - 1))
    return by.select("vendor", "signatures", "hits", "status", score.alias("score"), (1 - F.exp(-score / SCALE)).alias("confidence"))


def region_class(start_codes: Column, length: Column, incompressible: Column, hits: Column) -> Column:
    """video, empty, structured, container_without_video or unstructured; start codes decide before density does."""
    chance = length / float(1 << CHANCE_BITS)
    limit = chance + 6 * F.sqrt(chance) + 4
    return (
        F.when(start_codes > limit, "video").when(incompressible < EMPTY, "empty").when((incompressible < DENSE) & (hits == 0), "structured")
        .when(hits > 0, "container_without_video").otherwise("unstructured")
    )


def class_runs(blocks: DataFrame, order: str, length: str, kind: str, stretch: int) -> DataFrame:
    """(kind, run, blocks, bytes): neighbouring blocks of one class."""
    prev = with_previous(blocks, [], order, [], [order, length, kind], stretch)
    breaks = (F.col(f"prev_{order}") + F.col(f"prev_{length}") != F.col(order)) | (F.col(f"prev_{kind}") != F.col(kind))
    return runs(prev, [], order, [], breaks, "run", stretch).groupBy(kind, "run").agg(F.count("*").alias("blocks"), F.sum(length).alias("bytes"))


def blockmap_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): changed, only_first or only_second; equal blocks are left out."""
    x, y = a.select(F.col(key).alias("k1"), F.col(value).alias("v1")), b.select(F.col(key).alias("k2"), F.col(value).alias("v2"))
    state = F.when(F.col("k2").isNull(), "only_first").when(F.col("k1").isNull(), "only_second").when(F.col("v1") != F.col("v2"), "changed")
    return x.join(y, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k1", "k2").alias(key), state.alias("state")).where("state is not null")


def token_survey(tokens: DataFrame, samples: DataFrame, least: int = 50, spread: float = 0.10, enrichment: float = 20.0) -> DataFrame:
    """Tokens (token, sample) that occur often, in many samples, and far above the upper median of all tokens' counts. ``samples`` has one row: how many there are."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("sample").alias("in_samples"))
    sizes = counts.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one row for each distinct count
    ranked = sizes.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    median = ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("median"))
    joined = counts.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(samples))
    return joined.where((F.col("n") >= least) & (F.col("in_samples") >= spread * F.col("samples")) & (F.col("n") >= enrichment * F.col("median"))).select("token", "n", "in_samples", "median")


def modal_gap(places: DataFrame, token: str, sample: str, at: str) -> DataFrame:
    """(token, gap, times, places): the commonest distance between neighbouring places of a token in a sample; ties: the smallest."""
    w = Window.partitionBy(token, sample).orderBy(at)
    gap = places.withColumn("gap", F.lead(at).over(w) - F.col(at)).where("gap is not null")
    counts = gap.groupBy(token, "gap").agg(F.count("*").alias("times"))
    return counts.groupBy(token).agg(F.max_by("gap", F.struct("times", -F.col("gap"))).alias("gap"), F.max("times").alias("times"), F.sum("times").alias("places"))
