"""Neighbourhood operators on sparse rasters.

A raster here is a relation of its set pixels, so a step shuffles ink, not canvases. Every pixel
tells its neighbours and itself what it is, and one aggregation on (map_id, i) gathers that: no
self-join, the mask is read once, and partial sums are formed before the shuffle. Steps can be
chained without reading anything twice. Only what compares pairs of pixels joins, on (map_id, i).
Sizes are ``width`` and ``height`` of the canvas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import model

ALL = tuple(range(8))
SELF = 8


def neighbours(pixels: DataFrame, width: int, height: int, directions: tuple[int, ...] = ALL, *carry: str) -> DataFrame:
    """map_id, k, i, x, y of each pixel's neighbours within the canvas (and of itself, for SELF), with the pixel as src and its columns carried."""
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k in directions for dx, dy in [(*model.NEIGHBOURS, (0, 0))[k]]))
    moved = pixels.select("map_id", F.col("i").alias("src"), "x", "y", *carry, F.explode(steps).alias("s"))
    at = moved.select("map_id", "src", *carry, "s.k", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    inside = at.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    return inside.select("map_id", "src", *carry, "k", (F.col("y") * width + F.col("x")).alias("i"), "x", "y")


def dilate(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels that are set or next to one that is."""
    return neighbours(mask, width, height, (*ALL, SELF)).select("map_id", "i", "x", "y").distinct()


def hits(mask: DataFrame, width: int, height: int) -> DataFrame:
    """map_id, i, x, y, n, bits of the set pixels: how many neighbours are set, and which (bit k)."""
    told = neighbours(mask, width, height, (*ALL, SELF)).groupBy("map_id", "i", "x", "y")
    is_self = F.col("k") == SELF
    counted = told.agg(F.bool_or(is_self).alias("own"), F.count_if(~is_self).alias("n"), F.sum(F.when(is_self, 0).otherwise(F.expr("shiftleft(1, (k + 4) % 8)"))).cast("int").alias("bits"))
    return counted.filter("own").select("map_id", "i", "x", "y", "n", "bits")


def erode(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels whose eight neighbours are all set; beyond the canvas nothing is."""
    return hits(mask, width, height).filter("n = 8").select("map_id", "i", "x", "y")


def close_open(mask: DataFrame, width: int, height: int, times: int = 2) -> DataFrame:
    """(dilate, erode) and then (erode, dilate), each ``times`` over."""
    for steps in ((dilate, erode), (erode, dilate)):
        for _ in range(times):
            for step in steps:
                mask = step(mask, width, height)
    return mask


def bit(bits: Column, k: int) -> Column:
    return F.shiftright(bits, k).bitwiseAND(1)


#: Neighbours in the order P2..P9 of thinning: north first, then clockwise.
RING = (1, 2, 3, 4, 5, 6, 7, 0)


def crossings(bits: Column) -> Column:
    """How often the ring of neighbours goes from unset to set."""
    ring = [bit(bits, k) for k in RING]
    total = F.lit(0)
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        total = total + (1 - a) * b
    return total


def thin_substep(mask: DataFrame, width: int, height: int, second: bool = False) -> DataFrame:
    """The mask after one Zhang-Suen substep."""
    north, east, south, west = (bit(F.col("bits"), k) for k in (1, 3, 5, 7))
    gone = (north * east * west == 0) & (north * south * west == 0) if second else (north * east * south == 0) & (east * south * west == 0)
    drop = F.col("n").between(2, 6) & (crossings(F.col("bits")) == 1) & gone
    return hits(mask, width, height).filter(~drop).select("map_id", "i", "x", "y")


def smooth_pass(field: DataFrame, width: int, height: int) -> DataFrame:
    """map_id, i, x, y, t: the mean of each pixel and its set neighbours, of a field with float t (null: not reached)."""
    told = neighbours(field.filter("t is not null"), width, height, (*ALL, SELF), "t").groupBy("map_id", "i", "x", "y")
    mean = told.agg(F.bool_or(F.col("k") == SELF).alias("own"), F.avg(F.col("t").cast("double")).cast("float").alias("t"))
    return mean.filter("own").select("map_id", "i", "x", "y", "t")


def differences(orders: DataFrame, width: int, height: int, directions: tuple[int, ...]) -> DataFrame:
    """map_id, i, k, diff, ord, other of pixels and their neighbours in the given directions."""
    moved = neighbours(orders, width, height, directions, "ord")
    other = orders.select("map_id", "i", F.col("ord").alias("other"))
    return moved.join(other, ["map_id", "i"]).select("map_id", F.col("src").alias("i"), "k", "ord", "other", F.abs(F.col("ord") - F.col("other")).alias("diff"))


def edge_jumps(orders: DataFrame, width: int, height: int, k: float = 24.0, skip: int | None = 254) -> DataFrame:
    """map_id, jumps, worst: right and lower neighbours whose orders differ by more than 255 / k; codes from ``skip`` on don't count."""
    steps = differences(orders, width, height, (3, 5))
    if skip is not None:
        steps = steps.filter((F.col("ord") < skip) & (F.col("other") < skip))
    return steps.groupBy("map_id").agg(F.count_if(F.col("diff") > 255 / k).alias("jumps"), F.max("diff").alias("worst"))


def isolated_holes(orders: DataFrame, width: int, height: int, progress: float, k: float = 24.0, least: int = 6) -> DataFrame:
    """map_id, holes: closed pixels with at least ``least`` ink neighbours and as many open ones (alpha above 200)."""
    from strokeloom.functions.scalar import alpha_at

    alpha = orders.withColumn("alpha", alpha_at(F.col("ord"), F.lit(progress), F.lit(k)))
    is_self = F.col("k") == SELF
    told = neighbours(alpha, width, height, (*ALL, SELF), "alpha").groupBy("map_id", "i")
    around = told.agg(F.max(F.when(is_self, F.col("alpha"))).alias("own"), F.count_if(~is_self).alias("n"), F.count_if(~is_self & (F.col("alpha") > 200)).alias("open"))
    return around.filter("own is not null").groupBy("map_id").agg(F.count_if((F.col("own") <= 200) & (F.col("n") >= least) & (F.col("open") >= least)).alias("holes"))


def gradient_stats(orders: DataFrame, width: int, height: int) -> DataFrame:
    """map_id, pixels, flat, p50, p90, worst of each pixel's largest difference to a neighbour; percentiles by floor of rank."""
    steep = differences(orders, width, height, ALL).groupBy("map_id", "i").agg(F.max("diff").alias("g"))
    ranked = steep.select("map_id", "g", F.row_number().over(Window.partitionBy("map_id").orderBy("g", "i")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("map_id")).alias("n"))
    at = lambda q: F.max(F.when(F.col("r") == F.floor(F.col("n") * q) + 1, F.col("g")))
    return ranked.groupBy("map_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("g") == 0).alias("flat"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("g").alias("worst"))


def jump_histogram(orders: DataFrame, width: int, height: int) -> DataFrame:
    """bucket, n of order differences of right and lower neighbours, over all maps."""
    d = F.col("diff")
    bucket = F.when(d == 0, "0").when(d <= 2, "1-2").when(d <= 5, "3-5").when(d <= 10, "6-10").otherwise("over 10")
    return differences(orders, width, height, (3, 5)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
