"""Plane geometry in columns: similarity transforms from point pairs, and tiles that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def similarity(points: Column, targets: Column) -> Column:
    """Struct (a, b, x, y) of the scaling, turn and shift that bring ``points`` nearest to ``targets`` in least squares; null for fewer than two different points.

    Both are arrays of structs (x, y) of one length; a point p goes to (a p.x - b p.y + x, b p.x + a p.y + y). The closed
    form over centred coordinates; nothing is mirrored.
    """
    n = F.size(points)
    mean = lambda side, c: _sum(F.transform(side, lambda p: p[c].cast("double"))) / n
    centre = F.struct(mean(points, "x").alias("px"), mean(points, "y").alias("py"), mean(targets, "x").alias("tx"), mean(targets, "y").alias("ty"))

    def fitted(m: Column) -> Column:
        pairs = F.zip_with(points, targets, lambda p, t: F.struct((p["x"] - m["px"]).alias("u"), (p["y"] - m["py"]).alias("v"), (t["x"] - m["tx"]).alias("r"), (t["y"] - m["ty"]).alias("s")))
        total = lambda f: _sum(F.transform(pairs, f))
        sums = F.struct(total(lambda q: q["u"] * q["r"] + q["v"] * q["s"]).alias("c"), total(lambda q: q["u"] * q["s"] - q["v"] * q["r"]).alias("d"), total(lambda q: q["u"] * q["u"] + q["v"] * q["v"]).alias("w"))

        def told(s: Column) -> Column:
            a, b = s["c"] / F.nullif(s["w"], F.lit(0.0)), s["d"] / F.nullif(s["w"], F.lit(0.0))
            return F.when(s["w"] > 0, F.struct(a.alias("a"), b.alias("b"), (m["tx"] - a * m["px"] + b * m["py"]).alias("x"), (m["ty"] - b * m["px"] - a * m["py"]).alias("y")))

        return F.get(F.transform(F.array(sums), told), F.lit(0))

    sound = (n >= 2) & (n == F.size(targets)) & ~F.exists(points, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()) & ~F.exists(targets, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    return F.when(sound, F.get(F.transform(F.array(centre), fitted), F.lit(0)))


def moved(transform: Column, points: Column) -> Column:
    """Points after a transform."""
    return F.transform(points, lambda p: F.struct((transform["a"] * p["x"] - transform["b"] * p["y"] + transform["x"]).alias("x"), (transform["b"] * p["x"] + transform["a"] * p["y"] + transform["y"]).alias("y")))


def tile_starts(size: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles of one length along a side: a step of ``tile - overlap``, the last one set back so that it ends with the side; one tile for a side that is no longer."""
    step = tile - overlap
    if step <= 0:
        raise ValueError("tiles must be longer than their overlap")
    many = F.ceil((size - tile) / step).cast("int")
    return F.when(size <= tile, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), many), lambda k: F.least(k * step, (size - tile).cast("int"))))


def tiles(pictures: DataFrame, width: str, height: str, tile: int, overlap: int) -> DataFrame:
    """Rows of pictures with each of their tiles (tile_x, tile_y, tile_w, tile_h); sides without extent have none."""
    at = pictures.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("tile_x", F.explode(tile_starts(F.col(width), tile, overlap))).withColumn("tile_y", F.explode(tile_starts(F.col(height), tile, overlap)))
    return at.withColumn("tile_w", F.least(F.lit(tile), F.col(width))).withColumn("tile_h", F.least(F.lit(tile), F.col(height)))
