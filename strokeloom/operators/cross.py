"""The axis sweep of a cross as joins, aggregates and windows over many masks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strokeloom import model
from strokeloom.functions import scalar

#: Projections are rounded to this many digits before they fall into bins, so that engines agree at bin edges.
DIGITS = 6


def centred(mask: DataFrame) -> DataFrame:
    """map_id, i, u, v: pixels relative to their map's mean. A map's pixels are dealt to one partition, which all later steps by map keep.

    The number of partitions is given, as later rows are many times those that are dealt, so few bytes here must not be merged.
    """
    partitions = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = Window.partitionBy("map_id")
    from_mean = lambda c: F.col(c) - F.avg(c).over(whole)
    return mask.select("map_id", "i", "x", "y").repartition(partitions, "map_id").select("map_id", "i", from_mean("x").alias("u"), from_mean("y").alias("v"))


def axis_sweep(mask: DataFrame, band: int) -> DataFrame:
    """map_id, angle, normal_offset, score: the fullest ``band`` unit bins at every degree; the first of several.

    Pixels are moved once, before they are turned. They are counted per map, degree and bin before
    anything is ordered; a bin then stands for itself and the empty ones up to the next.
    """
    turned = centred(mask).select("map_id", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(model.ANGLES - 1))).alias("angle"))
    turn = F.radians(F.col("angle").cast("double"))
    place = F.floor(F.round(F.col("v") * F.cos(turn) - F.col("u") * F.sin(turn), DIGITS))
    counts = turned.groupBy("map_id", "angle", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    axis = Window.partitionBy("map_id", "angle").orderBy("bin")
    whole = axis.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = counts.select("*", F.lead("bin").over(axis).alias("next"), F.first("bin").over(whole).alias("lo"), F.last("bin").over(whole).alias("hi"))
    dense = reach.select("map_id", "angle", "lo", "hi", F.col("bin").alias("own"), "n", F.explode(F.sequence("bin", F.coalesce(F.col("next") - 1, F.col("bin")))).alias("bin"))
    sums = dense.select("map_id", "angle", "lo", "hi", "bin", F.sum(F.when(F.col("bin") == F.col("own"), F.col("n")).otherwise(0)).over(axis.rowsBetween(0, band - 1)).alias("s"))
    full = sums.filter((F.col("bin") == F.col("lo")) | (F.col("bin") + band - 1 <= F.col("hi")))
    best = full.groupBy("map_id", "angle").agg(F.max_by("bin", F.struct("s", -F.col("bin"))).alias("at"), F.max("s").alias("score"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    bins = F.col("hi") - F.col("lo") + 1
    return best.select("map_id", "angle", F.when(bins <= band, F.col("lo") + bins / 2).otherwise(F.col("at") + F.lit(band) / 2).alias("normal_offset"), "score")


def axis_pair(axes: DataFrame) -> DataFrame:
    """map_id and angle and offset of the backslash and the slash: the fullest axis and the fullest that is far enough from it. Maps without two have no row.

    The axes of a map, at most model.ANGLES, are one array, so the sweep is planned once.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "angle", "normal_offset")))
    both = axes.groupBy("map_id").agg(ranked.alias("all")).select("map_id", "all", F.col("all")[0].alias("f"))
    far = F.filter("all", lambda a: scalar.angular_separation(a["angle"], F.col("f.angle")) >= model.MIN_SEPARATION)
    both = both.select("map_id", "f", F.get(far, F.lit(0)).alias("s")).filter("s is not null")
    leans = lambda c: (F.col(f"{c}.angle") > 0) & (F.col(f"{c}.angle") < 90)
    is_first = F.when(leans("f"), True).when(leans("s"), False).otherwise(F.col("f.angle") <= F.col("s.angle"))
    pair = both.select("map_id", F.when(is_first, F.col("f")).otherwise(F.col("s")).alias("b"), F.when(is_first, F.col("s")).otherwise(F.col("f")).alias("c"))
    return pair.select("map_id", F.col("b.angle").alias("backslash_angle"), F.col("b.normal_offset").alias("backslash_offset"), F.col("c.angle").alias("slash_angle"), F.col("c.normal_offset").alias("slash_offset"))


def assign(mask: DataFrame, pairs: DataFrame, band: int) -> DataFrame:
    """map_id, i, on_backslash: the backslash owns what lies in its own half band, or nearer to it."""
    far = lambda name: F.round(scalar.normal_distance(F.col("u"), F.col("v"), F.col(f"{name}_angle"), F.col(f"{name}_offset"), F.lit(band)), DIGITS)
    met = centred(mask).join(pairs, "map_id")
    return met.select("map_id", "i", ((far("backslash") <= model.OWN_BAND) | (far("backslash") <= far("slash"))).alias("on_backslash"))


def road_distances(labelled: DataFrame, road: DataFrame, width: int) -> DataFrame:
    """map_id, component, distance of each blob's centre to the nearest road pixel. The join is within a map; blobs are aggregated before it."""
    centre = labelled.groupBy("map_id", "component").agg(F.avg(F.col("i") % width).alias("cx"), F.avg(F.floor(F.col("i") / width)).alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return centre.join(road.select("map_id", "x", "y"), "map_id").groupBy("map_id", "component").agg(F.sqrt(F.min(dx * dx + dy * dy)).alias("distance"))


def nearest_two(distances: DataFrame) -> DataFrame:
    """map_id, component, best, second: the nearest blob and the distance of the next."""
    order = Window.partitionBy("map_id").orderBy("distance", "component")
    ranked = distances.select("map_id", "component", F.col("distance").alias("best"), F.lead("distance").over(order).alias("second"), F.row_number().over(order).alias("r"))
    return ranked.filter("r = 1").drop("r")


def column_ink(mask: DataFrame, width: int) -> DataFrame:
    """map_id, x, ink of every column of every map that has ink."""
    found = mask.groupBy("map_id", "x").agg(F.count(F.lit(1)).alias("ink"))
    every = mask.select("map_id").distinct().select("map_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return every.join(found, ["map_id", "x"], "left").select("map_id", "x", F.coalesce("ink", F.lit(0)).alias("ink"))


def snap_cuts(columns: DataFrame, span: int, count: int) -> DataFrame:
    """map_id, cut, x: the thinnest column near each of count - 1 equal shares; the first of several."""
    cell = span / count
    slack = max(1, int(cell * 0.25 + 0.5))
    wants = F.explode(F.array(*(F.struct(F.lit(i).alias("cut"), F.lit(int(cell * i + 0.5)).alias("want")) for i in range(1, count))))
    near = columns.select("map_id", "x", "ink", wants.alias("w")).filter((F.abs(F.col("x") - F.col("w.want")) <= slack) & (F.col("x") > 0) & (F.col("x") < span))
    return near.groupBy("map_id", F.col("w.cut").alias("cut")).agg(F.min_by("x", F.struct("ink", "x")).alias("x"))


def cells(mask: DataFrame, cuts: DataFrame) -> DataFrame:
    """map_id, i, slot: how many cuts a pixel lies at or beyond. Cuts are gathered per map first, a few numbers each."""
    lists = cuts.groupBy("map_id").agg(F.collect_list("x").alias("cuts"))
    slot = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: c <= F.col("x")))
    return mask.join(lists, "map_id", "left").select("map_id", "i", slot.alias("slot"))
