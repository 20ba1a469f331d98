"""Leads and their evaluation: boxes, faces, titles, clocks, confusion counts."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import iou

#: Fixed limits of the leads.
STATIC_IOU, STATIC_SHARE, STATIC_LEAST, PARKED_IOU, MERGE_IOU, MATCH, EYE_PX = 0.8, 0.25, 4, 0.5, 0.5, 0.363, 12.0


def box(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in (1, 2, 3, 4)]


def static_boxes(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections (clip, t, label, id, x1..x4) with static: the same label stands in the same place in a quarter of the clip's frames and in four of them at least.

    Equal boxes are counted first and meet as one, so a box that stands still all through a clip is one row. A box's
    centre falls in a grid cell; boxes with this overlap have centres in the same or a neighbouring cell, so pairs are
    sought cell by cell and a busy clip is no single group.
    """
    side = 0.25
    cell = lambda lo, hi: F.floor((F.col(lo) + F.col(hi)) / 2 / side).cast("int")
    places = ["clip", "label", "x1", "x2", "x3", "x4"]
    kinds = detections.groupBy(*places).agg(F.count("*").alias("_times")).withColumn("_cx", cell("x1", "x3")).withColumn("_cy", cell("x2", "x4"))
    around = F.array(*[F.struct((F.col("_cx") + i).alias("cx"), (F.col("_cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    others = kinds.withColumn("_n", F.explode(around)).select("clip", "label", F.col("_n.cx").alias("_cx"), F.col("_n.cy").alias("_cy"), "_times", *[F.col(f"x{k}").alias(f"y{k}") for k in (1, 2, 3, 4)])
    near = kinds.drop("_times").join(others, ["clip", "label", "_cx", "_cy"]).where(iou(box("x"), box("y")) >= STATIC_IOU)
    counts = near.groupBy(*places).agg(F.sum("_times").alias("same"))
    joined = detections.join(counts, places).join(frames, "clip")
    return joined.select("id", "clip", "label", "same", ((F.col("same") >= STATIC_LEAST) & (F.col("same") >= STATIC_SHARE * F.col("frames"))).alias("static"))


def greedy(boxes: pd.DataFrame, overlap: float) -> list[int]:
    """Places of the boxes that stay when a box goes that overlaps a stronger one that stays; strongest first, ties by place."""
    order = boxes.sort_values(["score", "id"], ascending=[False, True], kind="stable").index.tolist()
    kept: list[int] = []
    xs = boxes[["x1", "x2", "x3", "x4"]].to_numpy()
    at = {i: k for k, i in enumerate(boxes.index)}

    def over(i: int, j: int) -> float:
        a, b = xs[at[i]], xs[at[j]]
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / union if union > 0 else 0.0

    for i in order:
        if all(over(i, j) < overlap for j in kept):
            kept.append(i)
    return kept


def merged_boxes(detections: DataFrame, keys: list[str], overlap: float = MERGE_IOU) -> DataFrame:
    """Detections that stay after greedy merging within one frame; a frame holds few boxes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[greedy(pdf, overlap)]

    return detections.groupBy(*keys).applyInPandas(run, detections.schema)


#: Vehicles that can be parked (fixed values).
PARKED = ("car", "bus", "truck")


def _overlaps(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Intersection over union of a box with others; zero without an area."""
    wide = np.maximum(np.minimum(box[2], boxes[:, 2]) - np.maximum(box[0], boxes[:, 0]), 0)
    high = np.maximum(np.minimum(box[3], boxes[:, 3]) - np.maximum(box[1], boxes[:, 1]), 0)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    union = area(box) + area(boxes) - wide * high
    return np.divide(wide * high, union, out=np.zeros(len(boxes)), where=union > 0)


def parked_spots(detections: DataFrame) -> DataFrame:
    """(clip, spot, label, frames, first, last, score): places where static vehicles keep standing, by the order in which they are first seen.

    Detections are (clip, t, id, label, score, x1..x4, static); other labels and moving ones do not count. A place is
    where its strongest box stands, so the order of time counts; its label is the commonest (ties: the first seen).
    A clip's static vehicles are one group: a clip is one video file, and its frames bound it.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"])
        boxes, scores = np.zeros((0, 4)), np.zeros(0)
        own = np.zeros(len(pdf), np.int64)
        for k, (box, score) in enumerate(zip(pdf[["x1", "x2", "x3", "x4"]].to_numpy(float), pdf["score"])):
            near = np.flatnonzero(_overlaps(box, boxes) >= PARKED_IOU)
            own[k] = near[0] if len(near) else len(boxes)
            if not len(near):
                boxes, scores = np.vstack((boxes, box)), np.append(scores, score)
            elif score > scores[own[k]]:
                boxes[own[k]], scores[own[k]] = box, score
        by = pdf.assign(spot=own).groupby("spot", sort=True)
        label = by["label"].agg(lambda x: x.value_counts(sort=False).reindex(x.unique()).idxmax())
        return pd.DataFrame({"clip": pdf["clip"].iloc[0], "spot": range(len(boxes)), "label": label.to_numpy(), "frames": by["t"].nunique().to_numpy(), "first": by["t"].min().to_numpy(), "last": by["t"].max().to_numpy(), "score": scores})

    counted = detections.where(F.col("static") & F.col("label").isin(*PARKED))
    return counted.groupBy("clip").applyInPandas(run, "clip bigint, spot bigint, label string, frames bigint, first bigint, last bigint, score double")


#: Wanted faces of a block, each one pass over all faces; and products that a task holds at once.
WANTED, PRODUCTS = 4096, 1 << 20


def _blocks_of(wanted: DataFrame, id_col: str, vec: str):
    """(ids, vectors) of the wanted faces, a bounded block at a time."""
    rows = wanted.select(F.col(id_col).cast("long"), F.col(vec)).orderBy(id_col).toLocalIterator()
    while part := list(islice(rows, WANTED)):
        yield np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.float64)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows of a with the same rows of b, left to right."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _pair_dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_dots`` of rows i of x with rows j of y, a bounded number of pairs at once."""
    most = 1 << 15
    return np.concatenate([np.zeros(0), *(_dots(x[i[k : k + most]], y[j[k : k + most]]) for k in range(0, len(i), most))])


def _vectors(batches, wanted: int):
    """(ids, vectors) of faces, so few at a time that their products with so many wanted ones stay bounded."""
    rows = max(1, PRODUCTS // wanted)
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            part = batch.slice(first, rows)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part.column(0).to_numpy(), flat.reshape(part.num_rows, -1)


def _best(k: int, j: np.ndarray, f: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (wanted place, face, similarity) of each wanted place, best first; ties: the smallest face."""
    order = np.lexsort((f, -s, j))
    j = j[order]
    keep = np.arange(len(j)) - np.searchsorted(j, j) < k
    return j[keep], f[order][keep], s[order][keep]


def nearest_faces(faces: DataFrame, wanted: DataFrame, k: int, id_col: str, vec: str, wanted_id: str, wanted_vec: str) -> DataFrame:
    """The k faces most like each wanted face, itself left out, with candidate marks; ties: the smallest id.

    Wanted faces are a query set of any size: a block of them at a time meets all faces. Tasks multiply bounded parts of
    their batches and keep the best k of each wanted face so far; only those are ranked together.
    """
    out = None
    for ids, vectors in _blocks_of(wanted, wanted_id, wanted_vec):

        def run(batches, ids=ids, vectors=vectors):
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            held, fresh, more = none, [], 0
            least = np.full(len(ids), -np.inf)  # the k-th best so far
            for own, x in _vectors(batches, len(ids)):
                near = x @ vectors.T
                near[own[:, None] == ids[None, :]] = -np.inf
                limit = np.maximum(least, np.partition(near, -k, axis=0)[-k]) if len(own) > k and np.isinf(least).any() else least
                i, j = np.nonzero((near >= limit - 1e-9) & np.isfinite(near))
                fresh.append((j, own[i], _pair_dots(x, i, vectors, j)))
                more += len(i)
                if more >= k * len(ids):
                    held, fresh, more = _best(k, *(np.concatenate(c) for c in zip(held, *fresh))), [], 0
                    first = np.searchsorted(held[0], np.arange(len(ids)))
                    full = np.bincount(held[0], minlength=len(ids)) == k
                    least[full] = held[2][first[full] + k - 1]
            j, f, s = _best(k, *(np.concatenate(c) for c in zip(held, *fresh)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(f), pa.array(s)], names=["w", "f", "s"])

        found = faces.select(F.col(id_col).cast("long").alias("f"), vec).mapInArrow(run, "w long, f long, s double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = faces.sparkSession.createDataFrame([], "w long, f long, s double")
    local = Window.partitionBy("w", "_t").orderBy(F.desc("s"), "f")
    whole = Window.partitionBy("w").orderBy(F.desc("s"), "f")
    some = out.withColumn("_t", F.pmod(F.xxhash64("f"), F.lit(64))).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
    return some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select(F.col("w").alias(wanted_id), F.col("f").alias(id_col), F.col("s").alias("similarity"), "rank", (F.col("s") >= MATCH).alias("candidate"))


def candidate_counts(faces: DataFrame, wanted: DataFrame, id_col: str, vec: str, wanted_id: str, wanted_vec: str, least: float = MATCH) -> DataFrame:
    """(wanted, compared, candidates): how many faces each wanted face was compared with, itself left out, and how many are like enough. Blocks as in nearest_faces; tasks give counts alone."""
    out = None
    for ids, vectors in _blocks_of(wanted, wanted_id, wanted_vec):

        def run(batches, ids=ids, vectors=vectors):
            compared, candidates = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for own, x in _vectors(batches, len(ids)):
                near = x @ vectors.T
                i, j = np.nonzero(np.abs(near - least) < 1e-9)  # where the order of the sum could decide
                near[i, j] = _pair_dots(x, i, vectors, j)
                other = own[:, None] != ids[None, :]
                compared += other.sum(axis=0)
                candidates += (other & (near >= least)).sum(axis=0)
            met = compared > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(compared[met]), pa.array(candidates[met])], names=["w", "compared", "candidates"])

        found = faces.select(F.col(id_col).cast("long").alias("f"), vec).mapInArrow(run, "w long, compared long, candidates long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = faces.sparkSession.createDataFrame([], "w long, compared long, candidates long")
    return out.groupBy(F.col("w").alias(wanted_id)).agg(F.sum("compared").alias("compared"), F.sum("candidates").alias("candidates"))


def truth_pairs(boxes: DataFrame, truth: DataFrame, least: float, side: float = 0.25) -> DataFrame:
    """(id, tid, o): boxes (clip, id, x1..x4) and true boxes (clip, tid, y1..y4) of one clip that overlap by more than nought and at least so much.

    Boxes are filed under every grid cell that they touch, and a pair counts in the first cell that both touch, so a
    clip with many boxes is no single group.
    """
    cell = lambda c: F.floor(F.col(c) / side).cast("int")

    def filed(df, p):
        return df.withColumn("_cx", F.explode(F.sequence(cell(f"{p}1"), cell(f"{p}3")))).withColumn("_cy", F.explode(F.sequence(cell(f"{p}2"), cell(f"{p}4"))))

    here = filed(boxes, "x").join(filed(truth, "y"), ["clip", "_cx", "_cy"])
    once = (F.col("_cx") == F.greatest(cell("x1"), cell("y1"))) & (F.col("_cy") == F.greatest(cell("x2"), cell("y2")))
    return here.where(once).withColumn("o", iou(box("x"), box("y"))).where((F.col("o") > 0) & (F.col("o") >= least)).select("clip", "id", "tid", "o")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion(rows: DataFrame, truth: Column, guess: Column, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, F1 and false-alarm rate (null where nothing can be divided); rows without a truth are left out."""
    t, g = truth.cast("boolean"), guess.cast("boolean")
    at = rows.where(truth.isNotNull())
    c = lambda cond: F.count_if(cond)
    by = (at.groupBy(*keys) if keys else at.groupBy()).agg(c(t & g).alias("tp"), c(~t & g).alias("fp"), c(t & ~g).alias("fn"), c(~t & ~g).alias("tn"))
    col = F.col
    return by.select(
        *keys, "tp", "fp", "fn", "tn", ratio(col("tp"), col("tp") + col("fp")).alias("precision"), ratio(col("tp"), col("tp") + col("fn")).alias("recall"),
        ratio(2 * col("tp"), 2 * col("tp") + col("fp") + col("fn")).alias("f1"), ratio(col("fp"), col("fp") + col("tn")).alias("false_alarm"),
    )


def clean_title(raw: Column) -> Column:
    """Letters, digits, blanks and a few marks, blanks made one, 3 to 32 characters with a letter; else null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9 _#-]", " "), " +", " "))
    return F.when(F.length(t).between(3, 32) & t.rlike("[A-Za-z]"), t)


def voted_titles(readings: DataFrame, stream: str, raw: Column, least: int = 3, share: float = 0.6) -> DataFrame:
    """(stream, title, readable, agree): the title that enough readings of a stream agree on without regard to case, in its commonest spelling; ties: the smallest."""
    ok = readings.select(stream, clean_title(raw).alias("t")).where("t is not null").withColumn("c", F.lower("t"))
    spelt = ok.groupBy(stream, "c", "t").agg(F.count("*").alias("n"))
    forms = spelt.groupBy(stream, "c").agg(F.sum("n").alias("agree"), F.min_by("t", F.struct((-F.col("n")).alias("a"), F.col("t").alias("b"))).alias("t"))
    best = forms.groupBy(stream).agg(F.sum("agree").alias("readable"), F.min(F.struct((-F.col("agree")).alias("n"), "c", "t")).alias("b"))
    agree = -F.col("b.n")
    return best.select(stream, "readable", agree.alias("agree"), F.when((F.col("readable") >= least) & (agree >= share * F.col("readable")), F.col("b.t")).alias("title"))
