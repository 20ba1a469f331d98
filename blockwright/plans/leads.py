"""Faces, boxes, titles, clocks and evaluation over embeddings, labels and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leads, titles
from .common import table


def _faces(spark, d) -> tuple[DataFrame, DataFrame]:
    """All faces, and as wanted ones every row whose id is divisible by twenty."""
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("wanted"), F.col("embedding").alias("wvec"))


def nearest_faces(spark: SparkSession, d: str) -> DataFrame:
    e, wanted = _faces(spark, d)
    got = leads.nearest_faces(e, wanted, 50, "vec_id", "embedding", "wanted", "wvec")
    return got.select("wanted", "vec_id", "rank", "candidate", F.round("similarity", 6).alias("similarity"))


def candidates(spark, d) -> DataFrame:
    """How many faces are candidates for each wanted face, among those large enough."""
    e, wanted = _faces(spark, d)
    return leads.candidate_counts(e.where(8 + F.col("vec_id") % 9 >= leads.EYE_PX), wanted, "vec_id", "embedding", "wanted", "wvec")


def _boxes(spark, d) -> DataFrame:
    """Boxes from whole-number parts of vectors: equal labels of a clip keep standing at a few places."""
    k = F.col("vec_id")
    x, y = (k % 5) / 8 + (k % 3) / 400, (k % 7) / 10 + (k % 2) / 500
    return table(spark, d, "embeddings").select(
        k.alias("id"), (k % 20).alias("clip"), F.floor(k / 20).cast("bigint").alias("t"), F.concat(F.lit("L"), (F.col("label") % 3).cast("string")).alias("label"), ((k * 37 % 101) / 101).alias("score"),
        x.alias("x1"), y.alias("x2"), (x + 0.2).alias("x3"), (y + 0.25).alias("x4"),
    )


def static_boxes(spark, d) -> DataFrame:
    boxes = _boxes(spark, d)
    frames = boxes.groupBy("clip").agg(F.countDistinct("t").alias("frames"))
    return leads.static_boxes(boxes, frames)


def frames_with(spark, d) -> DataFrame:
    """Frames in which a label is seen at all."""
    return _boxes(spark, d).groupBy("label").agg(F.countDistinct("clip", "t").alias("frames"), F.count("*").alias("boxes"), F.count_if(F.col("score") >= 0.5).alias("strong"))


def top_thumbnails(spark, d) -> DataFrame:
    """The six strongest boxes of each clip; ties: the smallest id."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip").orderBy(F.desc("score"), "id")
    return _boxes(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("clip", "rank", "id")


def truth_match(spark, d) -> DataFrame:
    """True boxes found (some box of the clip's label with an overlap of 0.3) and boxes without any true box near (below 0.1)."""
    boxes = _boxes(spark, d)
    truth = boxes.where("id % 10 = 0").select(F.col("id").alias("tid"), "clip", *[(F.col(f"x{k}") + 0.02).alias(f"y{k}") for k in (1, 2, 3, 4)])
    pairs = leads.truth_pairs(boxes.where("id % 10 <> 0"), truth, 0.1)
    found = truth.join(pairs.where("o >= 0.3").select("tid").distinct(), "tid", "left_semi").groupBy("clip").agg(F.count("*").alias("found"))
    far = boxes.where("id % 10 <> 0").join(pairs.where("o >= 0.1").select("id").distinct(), "id", "left_anti").groupBy("clip").agg(F.count("*").alias("alone"))
    total = truth.groupBy("clip").agg(F.count("*").alias("true_boxes"))
    return total.join(found, "clip", "left").join(far, "clip", "left").select("clip", "true_boxes", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("alone", F.lit(0)).alias("alone"))


def merged_boxes(spark, d) -> DataFrame:
    return leads.merged_boxes(_boxes(spark, d).withColumn("half", F.floor(F.col("t") / 10).cast("bigint")), ["clip", "half"]).select("id", "clip", "half")


def vehicles(spark, d) -> DataFrame:
    """The boxes as cars, buses and persons; three of four are taken to be static."""
    kind = F.when(F.col("label") == "L0", "car").when(F.col("label") == "L1", "bus").otherwise("person")
    return _boxes(spark, d).withColumn("label", kind).withColumn("static", F.col("id") % 4 != 0)


def parked_spots(spark, d) -> DataFrame:
    return leads.parked_spots(vehicles(spark, d))


def _judged(spark, d) -> DataFrame:
    """Labels with a rule as the guess: marks and capitals make a text poor."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.regexp_count("text", F.lit("[#$%&*!|]")).alias("marks"))
    return table(spark, d, "labels").join(docs, "doc_id")


def confusion(spark, d) -> DataFrame:
    return leads.confusion(_judged(spark, d), F.col("quality") == 1, F.col("marks") < 20, ["lang"])


def sweep(spark, d) -> DataFrame:
    rows = _judged(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (1, 5, 20, 50, 200)])))
    return leads.confusion(rows, F.col("quality") == 1, F.col("marks") < F.col("threshold"), ["threshold"])


def binned_recall(spark, d) -> DataFrame:
    """Recall by size of text."""
    rows = _judged(spark, d).withColumn("bin", F.width_bucket(F.log10(F.greatest("n_chars", F.lit(1)).cast("double")), F.lit(1.0), F.lit(5.0), F.lit(8)))
    return leads.confusion(rows, F.col("quality") == 1, F.col("marks") < 20, ["bin"]).select("bin", "tp", "fn", "recall")


def voted_titles(spark, d) -> DataFrame:
    """Two words of each turn as readings of a conversation's title: role and first word's length class."""
    reading = F.concat(F.initcap(F.col("role")), F.when(F.col("turn") % 3 == 0, F.lit("  #")).otherwise(F.lit(" ")), F.lit("x"), (F.col("conv_id") % 4).cast("string"))
    turns = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 5 == 4, F.upper(reading)).otherwise(reading).alias("raw"))
    return leads.voted_titles(turns, "conv_id", F.col("raw"))


def parsed_clocks(spark, d) -> DataFrame:
    """Clock readings in three orders of day, month and year; impossible ones are null, ambiguous ones are told by the container's time."""
    t = F.col("ts")
    written = F.when(F.col("event_id") % 3 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format(t, "dd/MM/yyyy HH:mm:ss")).otherwise(F.date_format(t, "MM/dd/yyyy HH:mm:ss"))
    e = table(spark, d, "events").select("event_id", "ts", written.alias("raw"))
    part = lambda p, k: F.regexp_extract("raw", p, k).try_cast("int")
    iso, other = r"^(\d{4})-(\d\d)-(\d\d) (\d\d):(\d\d):(\d\d)$", r"^(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d)$"
    make = lambda p, y, m, dd: F.try_make_timestamp_ntz(part(p, y), part(p, m), part(p, dd), part(p, 4), part(p, 5), part(p, 6).cast("double"))
    ymd, dmy, mdy = make(iso, 1, 2, 3), make(other, 3, 2, 1), make(other, 3, 1, 2)
    near = lambda c: F.abs(F.timestamp_diff("SECOND", c, F.col("ts")))
    best = F.when(ymd.isNotNull(), ymd).when(dmy.isNull(), mdy).when(mdy.isNull(), dmy).when(near(dmy) < near(mdy), dmy).when(near(mdy) < near(dmy), mdy).when(dmy == mdy, dmy)
    read = e.withColumn("read", best).withColumn("ambiguous", dmy.isNotNull() & mdy.isNotNull() & (dmy != mdy))
    return read.groupBy("ambiguous").agg(F.count("*").alias("n"), F.count("read").alias("parsed"), F.count_if(near(F.col("read")) <= 3).alias("agree"))


def painted_clocks(spark, d) -> DataFrame:
    """Event times as recorders paint them, in three layouts, with weekdays, halves of the day and letters read for digits; read back with the event's own hour as second source."""
    t = F.col("ts")
    day = F.date_format(t, "E")
    layouts = (F.concat(F.date_format(t, "dd-MM-yyyy "), day, F.date_format(t, " HH:mm:ss")), F.date_format(t, "MM/ dd/ yyyy hh: mm: ss a"), F.date_format(t, "yyyy.MM.dd HH:mm:ss"), F.date_format(t, "dd/MM/yyyy hh:mm:ss a"))
    clean = F.element_at(F.array(*layouts), (F.col("event_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("["), F.replace(clean, F.lit("202"), F.lit("2O2")), F.lit("]"))).otherwise(clean)
    read = table(spark, d, "events").select("event_id", "ts", titles.clock_readings(raw).alias("c"))
    got = titles.resolved(F.col("c.readings"), F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return read.select("event_id", got.alias("read"), titles.clock_verdict(got, F.col("ts")).alias("verdict"), F.col("c.half").alias("half"), F.col("c.weekday").alias("weekday"))


def title_forms(spark, d) -> DataFrame:
    """Names as text recognition might read them, as titles and in the form they are compared by."""
    raw = F.concat(F.lit("__"), F.replace("c_name", F.lit("#00"), F.lit(" O0")), F.lit("| *"))
    return table(spark, d, "customer").select("c_custkey", titles.normal_title(raw).alias("title"), titles.canonical(titles.normal_title(raw)).alias("form"))


_BOX = "b AS (SELECT vec_id AS id, vec_id % 20 AS clip, vec_id // 20 AS t, 'L' || (label % 3) AS label, (vec_id * 37 % 101)::DOUBLE / 101 AS score, (vec_id % 5)::DOUBLE / 8 + (vec_id % 3)::DOUBLE / 400 AS x1, (vec_id % 7)::DOUBLE / 10 + (vec_id % 2)::DOUBLE / 500 AS x2, x1 + 0.2::DOUBLE AS x3, x2 + 0.25::DOUBLE AS x4 FROM embeddings)"
_IOU = "greatest(least({a}3, {b}3) - greatest({a}1, {b}1), 0) * greatest(least({a}4, {b}4) - greatest({a}2, {b}2), 0)"
_INTER = lambda a, b: _IOU.format(a=a, b=b)
_OVER = lambda a, b: f"({_INTER(a, b)}) / (({a}3 - {a}1) * ({a}4 - {a}2) + ({b}3 - {b}1) * ({b}4 - {b}2) - ({_INTER(a, b)}))"
_JUDGED = "j AS (SELECT l.*, lang, n_chars, len(regexp_extract_all(text, '[#$%&*!|]')) AS marks FROM labels l JOIN documents USING (doc_id))"
_CONF = lambda key, guess, src="j": f"SELECT {key}, tp, fp, fn, tn, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, fp / nullif(fp + tn, 0)::DOUBLE AS false_alarm FROM (SELECT {key}, count(*) FILTER (WHERE quality = 1 AND {guess}) AS tp, count(*) FILTER (WHERE quality <> 1 AND {guess}) AS fp, count(*) FILTER (WHERE quality = 1 AND NOT {guess}) AS fn, count(*) FILTER (WHERE quality <> 1 AND NOT {guess}) AS tn FROM {src} GROUP BY 1)"
_SIM = "list_dot_product(e.embedding::DOUBLE[], w.embedding::DOUBLE[])"

QUERIES = {
    "t2_w23_nearest_faces": nearest_faces, "f_face_candidates": candidates, "j18_f12_static_boxes": static_boxes, "a29_frames_with": frames_with, "t3_top_thumbnails": top_thumbnails,
    "j19_truth_match": truth_match, "o14_merged_boxes": merged_boxes, "o15_parked_spots": parked_spots, "a30_confusion": confusion, "a31_threshold_sweep": sweep, "a32_binned_recall": binned_recall,
    "a26_voted_titles": voted_titles, "a28_parsed_clocks": parsed_clocks, "fn_painted_clocks": painted_clocks, "fn_title_forms": title_forms,
}

ORACLE_SQL = {
    "t2_w23_nearest_faces": f"WITH p AS (SELECT w.vec_id AS wanted, e.vec_id, {_SIM} AS s FROM embeddings e, embeddings w WHERE w.vec_id % 20 = 0 AND e.vec_id <> w.vec_id) SELECT wanted, vec_id, CAST(row_number() OVER (PARTITION BY wanted ORDER BY s DESC, vec_id) AS INTEGER) AS rank, s >= 0.363 AS candidate, round(s, 6) AS similarity FROM p QUALIFY rank <= 50",
    "f_face_candidates": f"SELECT w.vec_id AS wanted, count(*) AS compared, count(*) FILTER (WHERE {_SIM} >= 0.363) AS candidates FROM embeddings e, embeddings w WHERE w.vec_id % 20 = 0 AND e.vec_id <> w.vec_id AND 8 + e.vec_id % 9 >= 12 GROUP BY 1",
    "j18_f12_static_boxes": f"WITH {_BOX}, f AS (SELECT clip, count(DISTINCT t) AS frames FROM b GROUP BY 1), s AS (SELECT a.id, a.clip, a.label, count(*) AS same FROM b a JOIN b c ON a.clip = c.clip AND a.label = c.label WHERE {_OVER('a.x', 'c.x')} >= 0.8::DOUBLE GROUP BY ALL) SELECT id, clip, label, same, same >= 4 AND same >= 0.25::DOUBLE * frames AS static FROM s JOIN f USING (clip)",
    "a29_frames_with": f"WITH {_BOX} SELECT label, count(DISTINCT (clip, t)) AS frames, count(*) AS boxes, count(*) FILTER (WHERE score >= 0.5) AS strong FROM b GROUP BY 1",
    "t3_top_thumbnails": f"WITH {_BOX} SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY score DESC, id) AS INTEGER) AS rank, id FROM b QUALIFY rank <= 6",
    "j19_truth_match": f"WITH {_BOX}, t AS (SELECT id AS tid, clip, x1 + 0.02::DOUBLE AS y1, x2 + 0.02::DOUBLE AS y2, x3 + 0.02::DOUBLE AS y3, x4 + 0.02::DOUBLE AS y4 FROM b WHERE id % 10 = 0), p AS (SELECT b.id, t.tid, b.clip, {_OVER('b.x', 't.y')} AS o FROM b JOIN t USING (clip) WHERE b.id % 10 <> 0), g AS (SELECT clip, count(*) AS true_boxes, count(*) FILTER (WHERE tid IN (SELECT tid FROM p WHERE o >= 0.3)) AS found FROM t GROUP BY 1), a AS (SELECT clip, count(*) AS alone FROM b WHERE id % 10 <> 0 AND id NOT IN (SELECT id FROM p WHERE o >= 0.1) GROUP BY 1) SELECT clip, true_boxes, found, coalesce(alone, 0) AS alone FROM g LEFT JOIN a USING (clip)",
    "a30_confusion": f"WITH {_JUDGED} " + _CONF("lang", "marks < 20"),
    "a31_threshold_sweep": f"WITH {_JUDGED}, k AS (SELECT j.*, CAST(t AS INTEGER) AS threshold FROM j, unnest([1, 5, 20, 50, 200]) AS u(t)) " + _CONF("threshold", "marks < threshold", "k"),
    "a32_binned_recall": f"WITH {_JUDGED}, k AS (SELECT *, CAST(CASE WHEN log10(greatest(n_chars, 1)) < 1 THEN 0 WHEN log10(greatest(n_chars, 1)) >= 5 THEN 9 ELSE floor((log10(greatest(n_chars, 1)) - 1) / 0.5) + 1 END AS BIGINT) AS bin FROM j) SELECT bin, tp, fn, recall FROM (" + _CONF("bin", "marks < 20", "k") + ")",
    "a26_voted_titles": """WITH r AS (SELECT conv_id, turn, upper(role[1]) || lower(role[2:]) || CASE WHEN turn % 3 = 0 THEN '  #' ELSE ' ' END || 'x' || (conv_id % 4) AS s FROM conversations), w AS (SELECT conv_id, CASE WHEN turn % 5 = 4 THEN upper(s) ELSE s END AS raw FROM r),
        o AS (SELECT conv_id, trim(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9 _#-]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM w), v AS (SELECT conv_id, lower(t) AS c, t, count(*) AS n FROM o WHERE length(t) BETWEEN 3 AND 32 AND regexp_matches(t, '[A-Za-z]') GROUP BY ALL),
        f AS (SELECT conv_id, c, CAST(sum(n) AS BIGINT) AS agree, arg_min(t, (-n, t)) AS t FROM v GROUP BY 1, 2), b AS (SELECT conv_id, CAST(sum(agree) AS BIGINT) AS readable, arg_min(t, (-agree, c)) AS t, max(agree) AS agree FROM f GROUP BY 1) SELECT conv_id, readable, agree, CASE WHEN readable >= 3 AND agree >= 0.6::DOUBLE * readable THEN t END AS title FROM b""",
    "a28_parsed_clocks": """WITH w AS (SELECT ts, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') ELSE strftime(ts, '%m/%d/%Y %H:%M:%S') END AS raw FROM events),
    r AS (SELECT ts, try_strptime(raw, '%Y-%m-%d %H:%M:%S') AS ymd, try_strptime(raw, '%d/%m/%Y %H:%M:%S') AS dmy, try_strptime(raw, '%m/%d/%Y %H:%M:%S') AS mdy FROM w),
    n AS (SELECT *, abs(date_diff('second', ts, dmy)) AS a, abs(date_diff('second', ts, mdy)) AS b FROM r),
    p AS (SELECT ts, CASE WHEN ymd IS NOT NULL THEN ymd WHEN dmy IS NULL THEN mdy WHEN mdy IS NULL THEN dmy WHEN a < b THEN dmy WHEN b < a THEN mdy WHEN dmy = mdy THEN dmy END AS read, dmy IS NOT NULL AND mdy IS NOT NULL AND dmy <> mdy AS ambiguous FROM n)
    SELECT ambiguous, count(*) AS n, count(read) AS parsed, count(*) FILTER (WHERE abs(date_diff('second', ts, read)) <= 3) AS agree FROM p GROUP BY 1""",
    "fn_painted_clocks": "SELECT event_id, date_trunc('second', ts) AS read, 'agrees' AS verdict, CASE WHEN event_id % 4 IN (1, 3) THEN CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END END AS half, CASE WHEN event_id % 4 = 0 THEN left(dayname(ts), 3) END AS weekday FROM events",
    "fn_title_forms": "SELECT c_custkey, replace(c_name, '#00', ' 00') || '' AS title, lower(replace(c_name, '#00', ' 00')) AS form FROM customer",
}
